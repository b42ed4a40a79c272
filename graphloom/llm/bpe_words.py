"""BPE encoding and decoding of whole texts through a table of distinct words.

encode() cuts texts into words (runs without ASCII white space; letters apart from the marks after them, where the
tokenizer parts them too). A slice is some megabytes of texts. Each slice sends its distinct words, once each, to the
bucket of their hash, where every distinct word of the corpus is encoded once; the ids come back to the slice and are
joined to the words' positions. Only distinct words, their ids and the packed positions are shuffled, so a word that is
everywhere costs one row's share a slice. decode() joins each id to its piece: the piece table has one row per id of the
vocabulary, which bounds it, and is sent to all tasks.

Texts are read twice, for words and for positions; a slice is named by a digest of its words, so a slice that changed
between the readings is an error and never a wrong result. Within a slice words are told apart by 64-bit hashes.

Defined results: null and empty texts have no ids and decode to ''; rows that repeat a doc_id (or null) are encoded one by
one; an empty table gives no rows; other columns are ignored. Null ids decode to '', and ids outside the vocabulary are
left out, as the library does.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import small_batches
from graphloom.llm.tokens import WordEncoder, default_tokenizer, slices
from graphloom.llm.wordhash import word_spans

#: Bytes of text in a slice (a longer text is a slice of its own), and buckets of words per shuffle partition.
SLICE_BYTES, BUCKETS_PER_PARTITION = 4_000_000, 4
#: One row of a slice: the words of one of its buckets, their ids, or (bucket LAYOUT) the places of all its words.
PART, LAYOUT = "slice binary, bucket int, sizes binary, body binary, doc_ids array<long>, doc_words binary", 2**31 - 1


def pack_numbers(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as compressed planes of bytes: small ones cost little."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack_numbers(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class DistinctWords(WordEncoder):
    """Encodes each distinct word of the bucket at hand once."""

    _made: dict[str, WordEncoder] = {}
    bucket, memo = None, {}

    def ids_of(self, bucket: int, words: list[bytes]) -> list[np.ndarray]:
        if bucket != self.bucket:
            self.bucket, self.memo = bucket, {}
        new = [w for w in words if w not in self.memo]
        self.memo.update(zip(new, self._library([w.decode() for w in new]), strict=True))
        return [self.memo[w] for w in words]


class Slice:
    """The words of a column of texts. Distinct words are numbered by bucket, then by hash."""

    def __init__(self, column, refine, buckets: int):
        hashes, self.first, self.data, self.starts, self.ends = word_spans(column, refine=refine)
        distinct, self.where, slot = np.unique(hashes, return_index=True, return_inverse=True)
        self.key = hashlib.blake2b(distinct.tobytes(), digest_size=16).digest()
        bucket = (distinct % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        number = np.empty_like(order)
        number[order] = np.arange(len(order))
        self.slot, self.where, self.bucket = number[slot], self.where[order], bucket[order]

    def words(self):
        """(bucket, its words), bucket by bucket."""
        raw, s, e = self.data.tobytes(), self.starts[self.where].tolist(), self.ends[self.where].tolist()
        words = [raw[a:b] for a, b in zip(s, e, strict=True)]
        edges = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=-1)).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(self.bucket[a]), words[a:b]

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each distinct word occurs, and the steps between its places."""
        counts, order = np.bincount(self.slot, minlength=len(self.where)), np.argsort(self.slot, kind="stable")
        steps = np.diff(order, prepend=0)
        firsts = (np.cumsum(counts) - counts)[counts > 0]
        steps[firsts] = order[firsts]
        return counts, steps


def slots_of(counts: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The word's number at each place; the inverse of Slice.places()."""
    out = np.empty(len(steps), np.int64)
    ends = np.cumsum(counts)
    run = np.append(0, np.cumsum(steps))
    out[run[1:] - np.repeat(run[ends - counts], counts)] = np.repeat(np.arange(len(counts)), counts)
    return out


def encode(docs: DataFrame, tokenizer: str | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit numbers) of each document."""
    path, spark = tokenizer or default_tokenizer(), docs.sparkSession
    buckets = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def batch_of(rows):
        import pyarrow as pa

        schema = pa.schema([("slice", pa.binary()), ("bucket", pa.int32()), ("sizes", pa.binary()), ("body", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_words", pa.binary())])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def cut(batches):
        refine = DistinctWords.of(path).refine
        for batch in batches:
            for part in slices(batch, slice_bytes):
                yield part["doc_id"].to_pylist(), Slice(part["text"], refine, buckets)

    def words(batches):
        import zstandard

        for _, s in cut(batches):
            if rows := [(s.key, b, None, zstandard.compress(b" ".join(ws), 1), None, None) for b, ws in s.words()]:
                yield batch_of(rows)

    def layouts(batches):
        for doc_ids, s in cut(batches):
            counts, steps = s.places()
            yield batch_of([(s.key, LAYOUT, pack_numbers(counts), pack_numbers(steps), doc_ids, pack_numbers(np.diff(s.first)))])

    def look_up(batches):
        import zstandard

        table = DistinctWords.of(path)
        for batch in batches:
            rows = []
            for key, bucket, body in zip(batch["slice"].to_pylist(), batch["bucket"].to_pylist(), batch["body"].to_pylist(), strict=True):
                ids = table.ids_of(bucket, zstandard.decompress(body).split(b" "))
                rows.append((key, bucket, pack_numbers(np.array([len(x) for x in ids])), pack_numbers(np.concatenate(ids)), None, None))
            if rows:
                yield batch_of(rows)

    def join(batches):
        import pyarrow as pa

        at, bucket_before, sizes, ids = None, -1, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["slice"] != at:
                    at, bucket_before, sizes, ids = row["slice"], -1, [], []
                if row["bucket"] != LAYOUT:
                    if row["bucket"] != bucket_before:  # equal slices send equal rows
                        sizes.append(unpack_numbers(row["sizes"]))
                        ids.append(unpack_numbers(row["body"]))
                        bucket_before = row["bucket"]
                    continue
                slot = slots_of(unpack_numbers(row["sizes"]), unpack_numbers(row["body"]))
                size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
                if len(slot) and len(size) != slot.max() + 1:
                    raise ValueError("texts changed between the reading of words and that of places")
                flat = np.concatenate(ids).astype("<u4") if ids else np.zeros(0, "<u4")
                n, start = size[slot], (np.cumsum(size) - size)[slot]
                before = np.append(0, np.cumsum(n))
                out = flat[np.repeat(start - before[:-1], n) + np.arange(before[-1])].tobytes()
                edges = (before[np.append(0, np.cumsum(unpack_numbers(row["doc_words"])))] * 4).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array([out[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], ["doc_id", "ids"])

    found = texts.mapInArrow(words, PART).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(look_up, PART)
    parts = texts.mapInArrow(layouts, PART).unionByName(found).repartition("slice").sortWithinPartitions("slice", "bucket")
    return parts.mapInArrow(join, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """`encoded` with the column `decoded`: its ids' pieces, joined as the library's decode() does where a tokenizer
    has no decoder of its own."""
    import json

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path := tokenizer or default_tokenizer())
    with open(path) as file:
        if json.load(file).get("decoder"):
            raise ValueError("this tokenizer joins pieces by rules of its own")
    pieces = encoded.sparkSession.sparkContext.broadcast([library.id_to_token(i) for i in range(library.get_vocab_size(with_added_tokens=True))])

    def run(batches):
        import pyarrow as pa

        table = np.array([*pieces.value, None], object)
        for batch in batches:
            for part in slices(batch, SLICE_BYTES, "ids"):
                texts = []
                for raw in part["ids"].to_pylist():
                    found = table[np.minimum(np.frombuffer(raw or b"", "<u4"), len(table) - 1)].tolist()
                    texts.append(" ".join(x for x in found if x is not None) if None in found else " ".join(found))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in encoded.dtypes)
    return encoded.mapInArrow(run, f"{kinds}, decoded string")


def op12_bpe_words(spark, sf_dir):
    small_batches(spark)
    out = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
