"""Nearest-centroid language identification.

Texts become normalised TF-IDF vectors over hashed byte n-grams (1 to 3, of the lower-cased text with
ASCII other than letters as spaces). Each language has
several centroids, found by spherical k-means; a text gets the language of the nearest by cosine, and is rejected when
that cosine is under the language's radius for texts of like length. Radii come from the cosines of the sampled texts and
of pieces of them: the 1 % quantile of those of like length, less half its distance to the median, and at
most 0.6 times the median. Document frequencies cover all learnable documents; the k-means is fitted to
a sample of about `sample_per_language` documents of each language, chosen by a hash of doc_id.

Defined results: null text, or one without a letter, is `und` with score 0 and rejected; rows with a null lang teach
nothing and are predicted like others; without a learnable row all is `und`; ties take the language first in order;
repeated rows are judged one by one; other columns pass through `identify` unchanged.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.tokens import WordEncoder, slices

#: Hashed n-grams (a power of two), documents a language that k-means sees, and centroids a language.
DIMS, SAMPLE_PER_LANGUAGE, CENTROIDS = 4096, 300, 4
#: Characters of the pieces of sampled texts whose cosines give radii, bands of length (each four times the one before),
#: the quantile, and how many cosines a band needs for a radius of its own.
PIECES, BANDS, QUANTILE, LEAST_BAND = (8, 32, 128, 512, 2048), 24, 0.01, 20
#: ASCII other than lower-case letters becomes a space.
LETTERS_ONLY = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
LETTER = re.compile(r"[^\W\d_]")


def counts(text: str) -> np.ndarray:
    """How often each hashed n-gram of the whole text occurs; a long text is counted in pieces."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(LETTERS_ONLY) + b" ", np.uint8)
    total, raw = np.zeros(DIMS), raw[np.append(True, (raw[1:] != 32) | (raw[:-1] != 32))]  # runs of other characters count as one
    for at in range(0, len(raw), 1 << 20):
        b = raw[at : at + (1 << 20) + 2].astype(np.uint32)
        own = min(len(b), 1 << 20)  # starts of this piece
        two = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] + b[2:] * np.uint32(0xC2B2AE3D)
        for h in (b * np.uint32(0x27D4EB2F), two, three):
            h = h[:own]
            total += np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(20), minlength=DIMS)
    return total


def unit(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf) * idf
    return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)


def band(tf: np.ndarray) -> int:
    return min(int(np.log2(max(tf.sum(), 1))) // 2, BANDS - 1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids. Starts from rows spread evenly along the direction of greatest variance, where outliers are but
    the ends; a centroid that keeps under a fiftieth of the rows, or a single one, goes if others are left."""
    centred = x - x.mean(0)
    along = np.ones(len(x)) + np.arange(len(x)) / len(x)
    for _ in range(20):  # power iteration
        along = centred @ (centred.T @ along)
        along = along / max(np.linalg.norm(along), 1e-12)
    order = np.argsort(along, kind="stable")
    c = x[order[np.unique(((np.arange(k) + 0.5) * len(x) / k).astype(int))]]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    size = np.bincount((x @ c.T).argmax(1), minlength=len(c))
    large = size >= max(2, len(x) / 50)
    return c[large if large.any() else size > 0].astype(np.float32)


def radii(cos: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """The least cosine that isn't rejected, by band. A band with too few cosines takes the next shorter one's, which is
    lower; without any shorter, the next longer one's."""
    known = [b for b in range(BANDS) if (bands == b).sum() >= LEAST_BAND]
    out = np.zeros(BANDS)
    for b in range(BANDS):
        use = max((x for x in known if x <= b), default=min(known, default=None))
        low, middle = np.quantile(cos if use is None else cos[bands == use], [QUANTILE, 0.5])
        out[b] = min(max(low - (middle - low) / 2, low / 2), 0.6 * middle)  # a few alike cosines tell little of the spread
    return out


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each n-gram occurs, over all rows; DIMS sums come to the driver."""

    def run(batches):
        import pyarrow as pa

        WordEncoder.leave()
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for part in slices(batch):
                for text in filter(None, part["text"].to_pylist()):
                    df += counts(text) > 0
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(np.append(df, n))], ["slot", "n"])

    rows = docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMS + 1, np.int64)
    for slot, n in rows:
        out[slot] = n
    return out[:DIMS], int(out[DIMS])


class Centroids:
    def __init__(self, idf: np.ndarray, languages: list[str], centroids: np.ndarray, radius: np.ndarray):
        self.idf, self.languages, self.centroids, self.radius = idf, languages, centroids, radius

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, and whether it is rejected as too far."""
        if not text or not LETTER.search(text) or not self.languages:
            return "und", 0.0, True
        tf = counts(text)
        cos = self.centroids @ unit(tf, self.idf)
        best = int(np.argmax(cos))
        score = float(min(max(cos[best], 0.0), 1.0))
        return self.languages[best], score, score < float(self.radius[best, band(tf)])


def fit(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE, k: int = CENTROIDS) -> Centroids:
    """Learns from the rows whose lang isn't null. Short texts are far from any centroid, so each language has a radius
    for each band of length; pieces of the sampled texts show the cosines of short texts where the rows have few."""
    docs = docs.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    per_language = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}  # a row per language
    df, n = document_frequencies(docs)
    idf = np.log((1 + n) / (1 + df)) + 1
    if not per_language or not n:
        return Centroids(idf, [], np.zeros((0, DIMS), np.float32), np.zeros((0, BANDS)))
    share = F.create_map(*[F.lit(x) for lang, m in per_language.items() for x in (lang, min(1.0, sample_per_language / m))])
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def vectors(batches):
        import pyarrow as pa

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if not text or not LETTER.search(text):
                    continue
                starts = [(crc32(text[:64].encode("utf-8", "replace")) % (len(text) - n), n) for n in PIECES if n < len(text)]
                parts = [text, *[x for at, n in starts if LETTER.search(x := text[at : at + n])]]
                tfs = [counts(x) for x in parts]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(tfs)), pa.array([unit(tf, idf).tobytes() for tf in tfs], pa.binary()), pa.array([band(tf) for tf in tfs], pa.int32()), pa.array([i == 0 for i in range(len(tfs))])], ["lang", "v", "band", "whole"])

    def cluster(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["v", "band"])
        x = np.stack([np.frombuffer(v, np.float32) for v in pdf["v"]])
        c = spherical_kmeans(x[pdf["whole"].to_numpy()], k)
        radius = radii((x @ c.T).max(1), pdf["band"].to_numpy()).tolist()
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "c": [y.tobytes() for y in c], "radius": [radius] * len(c)})

    found = sample.mapInArrow(vectors, "lang string, v binary, band int, whole boolean").groupBy("lang").applyInPandas(cluster, "lang string, c binary, radius array<double>")
    rows = sorted(found.collect(), key=lambda r: (r["lang"], r["c"]))  # at most k rows per language
    return Centroids(idf, [r["lang"] for r in rows], np.array([np.frombuffer(r["c"], np.float32) for r in rows]).reshape(-1, DIMS), np.array([r["radius"] for r in rows]).reshape(-1, BANDS))


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """The documents with all their columns and lang_pred, score and rejected (which replace columns so named)."""
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    fields = [f for f in docs.schema.fields if f.name in rest]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double, rejected boolean"

    def run(batches):
        import pyarrow as pa

        WordEncoder.leave()
        for batch in batches:
            for part in slices(batch):
                lang, score, rejected = zip(*map(model.predict, part["text"].to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*[part[c] for c in rest], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], [*rest, "lang_pred", "score", "rejected"])

    return docs.select(*[f"`{c}`" for c in rest]).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op3_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
