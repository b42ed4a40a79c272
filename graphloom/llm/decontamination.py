"""Benchmark decontamination, with DataFrame functions only.

The benchmark's normalised windows form a hash table that is broadcast once its size is checked; documents are scanned
window by window, each hash hit is verified on the words, and hit spans or documents are removed.

Defined results: null, empty or wordless documents have no hit; null or wordless items have no window; items that share
a window all count; rows that repeat a doc_id are judged one by one; an empty benchmark hits nothing; other columns of
either table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import bounded, let, split_words

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words: ASCII other than digits and letters (before A-Z are lower-cased).
BREAKS_ANY_CASE = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Up to so many distinct benchmark windows (about 100 MB as a hash table) are broadcast; beyond, the join shuffles.
BROADCAST_WINDOWS = 400_000


def normal_words(text: Column) -> Column:
    """Words with A-Z in lower case. lower() is the faster form and equal to it where a word is ASCII."""
    upper_only = lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))
    return F.transform(split_words(text, BREAKS_ANY_CASE), upper_only)


def window_hash(words: Column, start: Column, length: int) -> Column:
    """The key of the `length` words from `start` (0-based): a hash of the length and of at most four of them. Hits
    are verified on all words."""
    return F.xxhash64(F.lit(length), *[F.get(words, start + k) for k in sorted({0, length // 3, 2 * length // 3, length - 1})])


def _windows(words: Column, length: int) -> Column:
    """The hashes of each run of `length` words, in order."""
    starts = F.when(F.size(words) >= length, F.sequence(F.lit(0), F.size(words) - length)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda i: window_hash(words, i, length))


def benchmark_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """h, window (its words), items (ids as sorted strings): the distinct windows of the benchmark."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), normal_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    each = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("window"))
    found = each.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    h = F.lit(None).cast("long")
    for k in range(n, 0, -1):
        h = F.when(F.size("window") == k, window_hash(F.col("window"), F.lit(0), k)).otherwise(h)
    return found.select(h.alias("h"), "window", "items", F.size("window").alias("l"))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """One row per document row: doc_id, th, n_words, spans (array of (p, l), verified occurrences) and items.

    One scan of the texts: a marker row for each document goes through the broadcast join beside its windows, so that
    documents without a hit need no second pass; only markers and hits are shuffled, keyed by document. A benchmark of
    more windows meets the documents by a shuffle of window hashes, without words, and only the documents with a
    hash that is met are read again to verify it."""
    windows = benchmark_windows(benchmark, n)
    lengths = sorted(r[0] for r in windows.select("l").distinct().collect())  # 1 to n: at most n rows
    key = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), normal_words(F.col("text")).alias("w"))
    marker = F.array(F.lit(0).cast("long"))
    hashes = let(F.col("w"), lambda w: F.concat(marker, *[_windows(w, k) for k in lengths]))
    sized = key.select("doc_id", "th", "w", F.size("w").alias("n_words"), hashes.alias("hashes"))
    spread = F.posexplode("hashes").alias("at", "k")
    before = F.lit(0)  # entries before those of the hit's length; then `at` counts from 1 among them
    for k in lengths:
        before = before + F.when(F.col("l") > k, F.greatest(F.col("n_words") - k + 1, F.lit(0))).otherwise(0)
    if bounded(windows, BROADCAST_WINDOWS):
        met = sized.select("doc_id", "th", "w", "n_words", spread).join(F.broadcast(windows), F.col("k") == F.col("h"), "left").where((F.col("at") == 0) | F.col("l").isNotNull())
        hits = met.withColumn("p", F.when(F.col("at") == 0, F.lit(0)).otherwise(F.col("at") - before))
        hits = hits.where((F.col("at") == 0) | ((F.col("p") >= 1) & (F.slice("w", F.greatest(F.col("p"), F.lit(1)), F.coalesce("l", F.lit(0))) == F.col("window"))))
        hits = hits.select("doc_id", "th", "n_words", (F.col("at") == 0).alias("mark"), F.when(F.col("at") > 0, F.array(F.struct("p", "l"))).alias("spans"), F.when(F.col("at") > 0, F.col("items")).alias("items"))
    else:
        slim = sized.select("doc_id", "th", "n_words", spread).where("at > 0").join(windows, F.col("k") == F.col("h")).withColumn("p", F.col("at") - before).where("p >= 1")
        # A document's hits are at most its windows, so the lists are bounded by its own text.
        listed = slim.groupBy("doc_id", "th").agg(F.collect_set(F.struct("p", "l", "window", "items")).alias("found")).toDF("hit_id", "hit_th", "found")
        again = key.join(listed, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")))
        true = F.filter("found", lambda x: F.slice(F.col("w"), x["p"], x["l"]) == x["window"])
        proved = again.select("doc_id", "th", F.size("w").alias("n_words"), F.lit(False).alias("mark"), true.alias("true"))
        proved = proved.select("doc_id", "th", "n_words", "mark", F.transform("true", lambda x: F.struct(x["p"].alias("p"), x["l"].alias("l"))).alias("spans"), F.flatten(F.transform("true", lambda x: x["items"])).alias("items"))
        none = sized.select("doc_id", "th", "n_words", F.lit(True).alias("mark"))
        hits = none.unionByName(proved, allowMissingColumns=True)
    per_doc = hits.groupBy("doc_id", "th").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.count_if("mark").alias("copies"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return per_doc.select("doc_id", "th", "n_words", "spans", "items", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def hit_words(spans: Column) -> Column:
    """How many words the spans (sorted by start) cover."""
    add = lambda a, s: F.struct(
        (a["n"] + F.greatest(s["p"] + s["l"] - F.greatest(s["p"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], s["p"] + s["l"]).alias("end")
    )
    return F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), add, lambda a: a["n"]).cast("long")


def remove_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "documents") -> DataFrame:
    """The documents with all their columns, without those that have a hit (`documents`), or with hit words cut out of
    the texts that have any (`spans`; their other words are joined by one space and are normalised)."""
    found = find_hits(docs, benchmark, n).where(F.size("spans") > 0).select("doc_id", "th", "spans").dropDuplicates(["doc_id", "th"]).toDF("hit_id", "hit_th", "hit_spans")
    # The row travels as one struct, so that no column of the documents can clash.
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64(F.coalesce("row.text", F.lit(""))) == F.col("hit_th"))
    if mode == "documents":
        return rows.join(found, same, "left_anti").select("row.*")
    words = normal_words(F.col("row.text"))
    kept = F.filter(F.transform(words, lambda w, i: F.when(~F.exists("hit_spans", lambda s: (i + 1 >= s["p"]) & (i + 1 < s["p"] + s["l"])), w)), lambda w: w.isNotNull())
    text = F.when(F.col("hit_spans").isNull(), F.col("row.text")).otherwise(F.array_join(kept, " "))
    return rows.join(found, same, "left").select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def op7_decontamination(spark, sf_dir):
    found = find_hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = hit_words(F.col("spans"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g, least(len(w), 10) AS l
       FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT rid, i, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM d, ls, unnest(range(1, len(w) - l + 2)) AS u(i) WHERE len(w) >= l),
hit AS (SELECT rid, i, dw.l, item FROM dw JOIN bw ON dw.g = bw.g AND dw.l = bw.l),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM hit, unnest(range(i, i + l)) AS u(p) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(it.s, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)
"""
