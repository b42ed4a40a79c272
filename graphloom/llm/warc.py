"""WARC archives with revisit resolution.

Headers (page, payload digest, size) are grouped by digest; of equal payloads of at least `least_bytes` the one with the
largest page_id is the response, and the others are joined to it as revisits. Archives are written anew: a response
carries its payload, a revisit only headers that refer to the response. Spark's text writer writes them, with the two
line ends that close a record as its separator, so any file system, retries and lost executors are its business.

Defined results: null html is the empty payload; rows with the same page_id and payload are alike, so both are responses
or both revisits; a null page_id is smaller than any other; an empty table gives an empty archive; other columns of the
input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import new_folder

CRLF = "\r\n"
#: Bytes of payloads in an archive file at most, unless one is longer, and its records. A task that reads a file holds it
#: compressed and inflates it piece by piece. Payloads over SMALL are written by class of size, each class up to four
#: times the one before.
FILE_BYTES, RECORDS_PER_FILE, SMALL = 1 << 30, 4_000, 1 << 18
#: Bytes that are inflated at a time.
PIECE = 1 << 20


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, payload_digest (hex SHA-1) and payload_bytes, without the payloads."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select("page_id", "url", F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))


def resolve(heads: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """The headers that become revisits, one per (page_id, payload_digest), with refers_to and the response's refers_url.

    Groups are summed before the shuffle, and only groups of several come to the join, whose large partitions Spark
    splits."""
    large = heads.where(F.col("payload_bytes") >= least_bytes)
    first = large.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.max_by("url", "page_id").alias("refers_url"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    later = F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to"))
    return large.join(first, "payload_digest").where(later).select("page_id", "payload_digest", "refers_to", "refers_url").dropDuplicates(["page_id", "payload_digest"])


def record_id(page_id: Column, digest: Column) -> Column:
    """An id of page and payload, so that a page's other payloads have their own and a revisit can name its response."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), digest))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def record(date: str) -> Column:
    """A record's text up to its payload's end, from page_id, url, html, payload_digest, payload_bytes, refers_to, refers_url."""
    revisit = F.col("revisit")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.coalesce("html", F.lit(""))))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"), F.col("payload_digest"))),
        F.lit(f"WARC-Date: {date}"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\\r\\n]", ""))),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("X-Page-ID: "), F.col("page_id"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("refers_to"), F.col("payload_digest")))),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page: "), F.col("refers_to"))),
        F.when(revisit & F.col("refers_url").isNotNull(), F.concat(F.lit("WARC-Refers-To-Target-URI: "), F.regexp_replace("refers_url", "[\\r\\n]", ""))),
        F.when(revisit, F.lit(f"WARC-Refers-To-Date: {date}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 1000, date: str | None = None) -> None:
    """Writes one record per row to gzip archives under `folder`, dated `date` (now, unless told). Payloads are shuffled
    once, by page."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    heads = headers(pages)
    found = resolve(heads, least_bytes).select(F.col("page_id").alias("_p"), F.col("payload_digest").alias("_d"), "refers_to", "refers_url")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    full = pages.select("page_id", "url", "html", F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    rows = full.join(found, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("payload_digest") == F.col("_d")), "left")
    rows = rows.withColumn("revisit", F.col("refers_to").isNotNull())
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0  # one number
    size, top = F.octet_length(F.coalesce("html", F.lit(""))), SMALL
    while True:  # one class of sizes for all but very long pages
        last = largest <= top
        some = rows if last and top == SMALL else rows.where((size <= top) & (size > (0 if top == SMALL else top // 4)) | (size == 0) & F.lit(top == SMALL))
        writer = some.select(record(date).alias("value")).write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip")
        writer.option("maxRecordsPerFile", max(1, min(RECORDS_PER_FILE, FILE_BYTES // top))).text(folder)
        if last:
            return
        top *= 4


def inflated(content) -> Iterator[bytes]:
    """An archive's bytes in pieces of at most PIECE; members of a gzip file follow one another."""
    left = memoryview(content)
    while len(left):
        stream = zlib.decompressobj(47)
        while not stream.eof:
            piece = stream.decompress(left[:PIECE], PIECE)
            taken = len(left[:PIECE]) - len(stream.unconsumed_tail) - len(stream.unused_data)
            if not piece and not taken:
                raise ValueError("an archive ends within its compressed data")
            left = left[taken:]
            yield piece


def records(pieces: Iterable[bytes]) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of each record of an archive that comes in pieces; one record and one piece are held. Blocks are
    taken by length, never by their content."""
    held, more = bytearray(), iter(pieces)

    def reach(n: int) -> bool:
        while len(held) < n:
            if (piece := next(more, None)) is None:
                return False
            held.extend(piece)
        return True

    while reach(1):
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not reach(len(held) + 1):
                raise ValueError("an archive ends within a record's headers")
        lines = held[:end].decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins with {lines[0][:40]!r}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        stop = end + 4 + int(head["content-length"])
        if not reach(stop):
            raise ValueError("an archive ends within a record")
        yield head, bytes(held[end + 4 : stop])
        reach(stop + 4)
        del held[: stop + 4]


def read_archives(spark, folder: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload (null for revisits). Sizes and
    digests of responses are taken from the payload that was read; those of revisits from their headers."""

    def run(batches):
        import pyarrow as pa
        from hashlib import sha1

        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for head, block in records(inflated(content.as_buffer())):
                    top, _, payload = block.partition(b"\r\n\r\n")
                    revisit = head["warc-type"] == "revisit"
                    size = int(top.rpartition(b"Content-Length: ")[2]) if revisit else len(payload)
                    digest = head["warc-payload-digest"].removeprefix("sha1:") if revisit else sha1(payload).hexdigest()
                    rows.append((number(head.get("x-page-id")), head.get("warc-target-uri"), head["warc-type"], number(head.get("x-refers-to-page")), size, digest, None if revisit else payload))
                    held += len(block)
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("content")
    return files.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def op2_warc(spark, sf_dir):
    folder = new_folder(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS m FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id < m THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < m THEN m END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND payload_bytes >= 1000
"""
