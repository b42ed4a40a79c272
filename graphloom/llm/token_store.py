"""Raw token-id shards with a minimal perfect hash index.

A shard holds documents of one range of doc_ids, ascending: their ids as raw little-endian words, each document closed by
the end id, then a directory (an Arrow stream), its length, and a mark. Spark's text writer writes the shards, with the
end id as its line separator, so that retries, lost executors and any file system are its business. The index maps
(doc_id, n-th row with it) to shard, offset and length: keys are dealt by hash to parts of bounded size, each part is a
cascade of bit arrays (a key's slot is the rank of its bit) with a slot table and a 32-bit fingerprint per slot.

Defined results: null or empty text is the end id alone; rows that repeat a doc_id lie side by side in the order of
their texts and are keyed by their number among them; a null doc_id sorts first and is a key like others; an empty
table gives an empty store; other columns of the input are ignored.
"""

from __future__ import annotations

import struct
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import new_folder
from graphloom.llm.tokens import WordEncoder, default_tokenizer, slices

MARK = b"IDSHARD1"
#: Keys in a part of the index, on average.
PART_KEYS = 40_000
#: Bytes of text to a shard; small inputs have a shard for each shuffle partition.
SHARD_BYTES = 256 << 20
#: An index of more parts than the first is read by the parts that are asked for, where these are at most the second.
WHOLE_INDEX_PARTS, PRUNED_PARTS = 64, 1_000
#: Bits per remaining key in each bit array of the cascade, and how many arrays there are.
GAMMA, LEVELS = 2.0, 24


def _open(path: str):
    """A file that any executor can reach: pyarrow opens file:, hdfs:, s3: and other addresses."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over hashes, another for each seed."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit key hashes: slot_of(keys) is 0 to n - 1, or -1."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(base + np.cumsum(bits, dtype=np.int64) - 1)
            base += int(bits.sum())
        self.base = base

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left) and len(levels) < LEVELS:
            size = max(64, int(GAMMA * len(left)))
            at = (mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[at]]
        return cls(levels, np.sort(left))  # what the cascade doesn't part is looked up by value

    def slot_of(self, keys: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for seed, bits in enumerate(self.levels):
            at = (mix(keys[todo], seed) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[todo[hit]] = self.ranks[seed][at[hit]]
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            same = self.rest[at] == keys[todo]
            out[todo[same]] = self.base + at[same]
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<II", len(self.levels), len(self.rest)) + b"".join(struct.pack("<I", len(b)) for b in self.levels)
        return head + b"".join(np.packbits(b).tobytes() for b in self.levels) + self.rest.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple[PerfectHash, int]:
        n, rest = struct.unpack_from("<II", raw)
        sizes, at, levels = struct.unpack_from(f"<{n}I", raw, 8), 8 + 4 * n, []
        for size in sizes:
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, (size + 7) // 8, at), count=size).astype(bool))
            at += (size + 7) // 8
        return cls(levels, np.frombuffer(raw, "<u8", rest, at)), at + 8 * rest


SLOT = np.dtype([("shard", "<i4"), ("offset", "<i8"), ("n", "<i8"), ("fp", "<u4")])


def build_part(kh: np.ndarray, fp: np.ndarray, shard, offset, n) -> bytes:
    if len(np.unique(kh)) < len(kh):
        raise ValueError("two keys of one part have the same 64-bit hash")
    ph = PerfectHash.build(kh)
    table = np.zeros(len(kh), SLOT)
    slot = ph.slot_of(kh)
    for name, values in (("shard", shard), ("offset", offset), ("n", n), ("fp", fp)):
        table[name][slot] = values
    return ph.to_bytes() + table.tobytes()


def look_up(blob: bytes, kh: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """The slot rows of keys; shard is -1 for a key that the index doesn't hold."""
    ph, at = PerfectHash.from_bytes(blob)
    table, slot = np.frombuffer(blob, SLOT, offset=at), ph.slot_of(kh)
    out = table[np.maximum(slot, 0)].copy() if len(table) else np.zeros(len(kh), SLOT)
    out["shard"][(slot < 0) | (out["fp"] != fp)] = -1
    return out


def _keyed(df: DataFrame, n_parts: int) -> DataFrame:
    """Adds kh (the key's hash), fp (32 bits of another) and the part of the index."""
    key = F.concat_ws("#", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("nth").cast("string"))
    kh = F.xxhash64(key)
    return df.withColumn("kh", kh).withColumn("fp", F.hash(F.lit(7), key)).withColumn("part", F.pmod(F.xxhash64(F.lit(1), key), F.lit(n_parts)).cast("int"))


class TokenStore:
    """A written store: shard files and the index. read(keys) gives the ids of keys by the index."""

    def __init__(self, spark, folder: str, dtype: str, n_parts: int, shards: list[tuple[int, str, int]]):
        self.spark, self.folder, self.dtype, self.n_parts = spark, folder, dtype, n_parts
        self.paths = {s: p for s, p, _ in shards}
        self.bases, total = {}, 0
        for s, _, n in shards:
            self.bases[s], total = total, total + n

    def _index(self, keyed: DataFrame) -> DataFrame:
        """The index, or of a large one the parts that a few keys need: its files are ranges of parts, so Parquet's
        bounds leave out the rest."""
        index = self.spark.read.schema("part int, blob binary").parquet(f"{self.folder}/index")
        if self.n_parts <= WHOLE_INDEX_PARTS:
            return index
        parts = [r["part"] for r in keyed.select("part").distinct().limit(PRUNED_PARTS + 1).collect()]
        return index.where(F.col("part").isin(parts)) if len(parts) <= PRUNED_PARTS else index

    def locate(self, keys: DataFrame) -> DataFrame:
        """keys (doc_id, nth) → doc_id, nth, shard (-1: not held), offset and n, in ids."""

        def run(left, right):
            import pandas as pd

            if not len(left):
                return pd.DataFrame({"doc_id": pd.Series(dtype="Int64"), "nth": [], "shard": [], "offset": [], "n": []})
            if not len(right):
                return left[["doc_id", "nth"]].assign(shard=-1, offset=0, n=0)
            got = look_up(right["blob"].iloc[0], left["kh"].to_numpy().view(np.uint64), left["fp"].to_numpy().astype(np.int32).view(np.uint32))
            return left[["doc_id", "nth"]].assign(shard=got["shard"], offset=got["offset"], n=got["n"])

        keyed = _keyed(keys, self.n_parts)
        index = self._index(keyed)
        # doc_id travels as text: pandas has no whole numbers beside nulls.
        keyed = keyed.withColumn("doc_id", F.col("doc_id").cast("string"))
        found = keyed.groupBy("part").cogroup(index.groupBy("part")).applyInPandas(run, "doc_id string, nth int, shard int, offset long, n long")
        return found.withColumn("doc_id", F.col("doc_id").cast("long"))

    def read(self, keys: DataFrame) -> DataFrame:
        """keys (doc_id, nth) → doc_id, nth, start (ids before it in the store), n_tokens, ids (u32), for keys held."""
        width, dtype, paths, bases = int(self.dtype[-1]), self.dtype, self.paths, self.bases

        def run(batches):
            import pyarrow as pa

            at, source = None, None
            for batch in batches:
                doc, nth, shard, offset, n = (batch[c] for c in ("doc_id", "nth", "shard", "offset", "n"))
                shard, offset, n = (c.to_numpy() for c in (shard, offset, n))
                lo = 0
                while lo < len(shard):
                    hi = lo + 1  # neighbours in the same shard, up to a few MB, are read at once
                    while hi < len(shard) and shard[hi] == shard[lo] and offset[hi] + n[hi] - offset[lo] <= 2_000_000 and offset[hi] - offset[hi - 1] - n[hi - 1] <= 4096:
                        hi += 1
                    if shard[lo] != at:
                        at, source = shard[lo], _open(paths[int(shard[lo])])
                    source.seek(int(offset[lo]) * width)
                    ids = np.frombuffer(source.read(int(offset[hi - 1] + n[hi - 1] - offset[lo]) * width), dtype).astype("<u4")
                    raw = [ids[offset[i] - offset[lo] : offset[i] - offset[lo] + n[i]].tobytes() for i in range(lo, hi)]
                    yield pa.RecordBatch.from_arrays([doc.slice(lo, hi - lo), nth.slice(lo, hi - lo), pa.array(offset[lo:hi] + bases[int(at)]), pa.array(n[lo:hi]), pa.array(raw, pa.binary())], ["doc_id", "nth", "start", "n_tokens", "ids"])
                    lo = hi

        held = self.locate(keys).where(F.col("shard") >= 0)
        near = held.repartition("shard").sortWithinPartitions("shard", "offset")
        return near.mapInArrow(run, "doc_id long, nth int, start long, n_tokens long, ids binary")


def write_store(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, n_shards: int | None = None) -> TokenStore:
    """Encodes the documents into shards under `folder` and builds the index beside them. Each byte of the end id must
    be below 128, since it is the text writer's separator."""
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    dtype = "<u2" if WordEncoder.of(path).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
    width = int(dtype[-1])
    end = np.array([end_id], dtype).tobytes()
    if max(end) > 127:
        raise ValueError(f"end id {end_id} has a byte over 127")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if n_shards is None:
        n_shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
        if int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > n_shards * SHARD_BYTES:
            size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # the estimate may be far off; this is exact
            n_shards = max(n_shards, -(-size // SHARD_BYTES))

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, offset, last, doc, nth, starts, sizes = WordEncoder.of(path), 0, None, [], array("i"), array("q"), array("q")
        for batch in batches:
            for part in slices(batch):
                raw = encoder.ids(part["text"], dtype)
                doc.append(part["doc_id"])
                for d, ids in zip(part["doc_id"].to_pylist(), raw, strict=True):
                    nth.append(nth[-1] + 1 if nth and last == d else 0)
                    last = d
                    starts.append(offset)
                    sizes.append(len(ids) // width + 1)
                    offset += sizes[-1]
                yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], ["payload"])
        if nth:
            table = pa.table({"doc_id": pa.chunked_array(doc, pa.int64()), "nth": pa.array(nth, pa.int32()), "offset": pa.array(starts, pa.int64()), "n": pa.array(sizes, pa.int64())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            foot = sink.getvalue().to_pybytes()
            yield pa.RecordBatch.from_arrays([pa.array([foot + struct.pack("<QQ", len(foot), TaskContext.get().partitionId()) + MARK], pa.binary())], ["payload"])

    ordered = rows.repartitionByRange(n_shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    written = ordered.mapInArrow(encode, "payload binary").select(F.col("payload").cast("string").alias("value"))
    written.write.option("lineSep", end.decode()).text(f"{folder}/shards")

    def directory(path: str) -> tuple[int, object]:
        import pyarrow as pa

        with _open(path) as f:
            tail = 24 + len(end)
            f.seek(f.size() - tail)
            size, shard, mark = struct.unpack("<QQ8s", f.read(24))
            if mark != MARK:
                raise ValueError(f"{path} is no shard")
            f.seek(f.size() - tail - size)
            return shard, pa.ipc.open_stream(f.read(size)).read_all()

    def summary(batches):
        import pyarrow as pa

        for batch in batches:
            for p in batch["path"].to_pylist():
                shard, table = directory(p)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [p], "tokens": pa.array([sum(table["n"].to_pylist())], pa.int64()), "docs": pa.array([len(table)], pa.int64())})

    def entries(batches):
        import pyarrow as pa

        for batch in batches:
            for p in batch["path"].to_pylist():
                shard, table = directory(p)
                yield from table.append_column("shard", pa.array([shard] * len(table), pa.int32())).to_batches(max_chunksize=10_000)

    files = spark.read.format("binaryFile").load(f"{folder}/shards").where("length > 0").select("path")
    files = files.repartition(max(1, min(n_shards, 1000)))
    shards = sorted(tuple(r) for r in files.mapInArrow(summary, "shard int, path string, tokens long, docs long").collect())  # a row per shard
    n_parts = max(1, -(-sum(s[3] for s in shards) // PART_KEYS))

    def build(pdf):
        import pandas as pd

        blob = build_part(pdf["kh"].to_numpy().view(np.uint64), pdf["fp"].to_numpy().astype(np.int32).view(np.uint32), pdf["shard"], pdf["offset"], pdf["n"])
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "blob": [blob]})

    held = _keyed(files.mapInArrow(entries, "doc_id long, nth int, offset long, n long, shard int"), n_parts).drop("doc_id", "nth")
    held.repartitionByRange("part").groupBy("part").applyInPandas(build, "part int, blob binary").write.parquet(f"{folder}/index")
    return TokenStore(spark, folder, dtype, n_parts, [s[:3] for s in shards])


def document_keys(docs: DataFrame) -> DataFrame:
    """doc_id, nth for each row of the documents."""
    counted = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count()
    return counted.select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("count") - 1).cast("int"))).alias("nth"))


def op8_token_store(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = write_store(docs, new_folder(spark, "token-store"))
    return store.read(document_keys(docs)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
