"""Host-level quality rules, with DataFrame functions only.

Each document gets counts and rule failures from its whole text; failures are summed by host, each host's failure
rate is shrunk with a beta prior fitted to all hosts, and the host's verdict is joined back to its documents.

Defined results: null or empty text has no words and fails the base rules; a null source is the host ''; rows that
repeat a doc_id are judged one by one; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import let, split_words, staged

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Bits of a packed long that hold a word's position. Longer documents compare all windows as strings.
POSITION_BITS = 24


def repeated_words(words: Column, n_words: Column) -> Column:
    """How many words lie in a three-word window that is found at least twice in `words` (first time included).

    Windows are sorted by 40 bits of hash packed with their position, as primitive longs; those whose neighbour has
    the same bits are compared again as strings, so the result is exact."""
    mask = -(1 << POSITION_BITS)

    def packed(i):
        h = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        return h.bitwiseAND(F.lit(mask)).bitwiseOR(i.cast("long"))

    starts = F.when(n_words > 2, F.sequence(F.lit(0), (n_words - 3).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))

    def same(x: Column, y: Column) -> Column:
        return F.coalesce(F.shiftright(x, POSITION_BITS) == F.shiftright(y, POSITION_BITS), F.lit(False))

    def candidates(s: Column) -> Column:
        near = F.filter(s, lambda x, j: same(x, F.get(s, j + 1)) | F.when(j > 0, same(x, F.get(s, j - 1))).otherwise(F.lit(False)))
        return F.transform(near, lambda x: x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int"))

    found = F.when(n_words <= 1 << POSITION_BITS, let(F.sort_array(F.transform(starts, packed)), candidates)).otherwise(starts)

    def exact(p: Column) -> Column:
        def equal(x, j):
            return F.coalesce(x["w"] == F.get(p, j)["w"], F.lit(False))

        kept = F.filter(p, lambda x, j: equal(x, j + 1) | F.when(j > 0, equal(x, j - 1)).otherwise(F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(kept, lambda x: F.sequence(x["i"], x["i"] + 2)))))

    pairs = F.transform(found, lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")))
    return let(F.sort_array(pairs), exact).cast("long")


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id, host and the counts of each document's whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    host = F.lower(F.coalesce(F.col("source"), F.lit("")))
    host = F.when(host.contains("://"), F.regexp_extract(host, "://([^/?#:]*)", 1)).otherwise(host)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    base = docs.select("doc_id", host.alias("host"), text.alias("text"))
    plain = F.col("text")
    for symbol in SYMBOLS:  # one byte each
        plain = F.replace(plain, F.lit(symbol), F.lit(""))
    base = base.select(
        "doc_id",
        "host",
        split_words(F.col("text")).alias("words"),
        (F.octet_length("text") - F.octet_length(plain)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
    )
    n_words = F.size("words").cast("long")
    return base.select(
        "doc_id",
        "host",
        n_words.alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        F.col("lines.n").alias("n_lines"),
        F.col("lines.dup").alias("n_dup_lines"),
        let(F.col("words"), lambda w: repeated_words(w, F.size(w))).alias("n_repeat_words"),
    )


def document_failures(features: DataFrame) -> DataFrame:
    """Adds base_failed (too short, or mostly repeated) and rule_failed (base, symbols, repeated lines, word length)."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    more = (
        (10 * F.col("n_symbols") > F.col("word_chars"))
        | (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))
        | (F.col("word_chars") > 12 * F.col("n_words"))
        | (F.col("word_chars") < 2 * F.col("n_words"))
    )
    return features.withColumn("base_failed", base).withColumn("rule_failed", base | more)


def host_verdicts(failures: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk), host_failed. The beta prior's mean is the failure rate of all documents; its
    strength is that of the beta-binomial by moments, with hosts weighted by their documents, so that the noise of small
    hosts isn't taken for a spread of rates. It is held between 1 and 10,000 pseudo-documents; without any spread beyond
    noise it is the most."""
    hosts = failures.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("rule_failed").alias("n_failed"))
    n, f = F.col("n_docs"), F.col("n_failed")
    sums = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(f * f / n).alias("ff"), F.sum(n * n).alias("nn")).first()  # one row: the prior's two numbers
    m = sums["f"] / sums["n"] if sums["n"] else 0.0
    spread = (sums["ff"] - sums["f"] * m) / (m * (1 - m)) - (sums["k"] - 1) if 0 < m < 1 else 0.0
    room = sums["n"] - sums["nn"] / sums["n"] - (sums["k"] - 1) if sums["n"] else 0.0
    strength = min(max(room / spread - 1, 1.0), 10000.0) if spread > 1e-9 and room > 1e-9 else 10000.0
    rate = (m * strength + F.col("n_failed")) / (strength + F.col("n_docs"))
    return hosts.select("host", "n_docs", "n_failed", rate.alias("rate"), (rate > max_rate).alias("host_failed"))


def apply_host_rules(docs: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """One row per document with its counts, its host's shrunk failure rate and `kept`.

    A document that fails the base rules goes. At a host whose shrunk rate is over `max_rate`, a document stays only
    if it passes every rule; at other hosts it stays. The texts are read once: the counts are staged, and only they
    are grouped and joined, so that a host with a third of all rows moves slim rows only (pre-aggregated for the
    verdicts; the join's large partitions are split by Spark)."""
    failures = staged(document_failures(document_features(docs)), "quality")
    verdicts = host_verdicts(failures, max_rate)
    joined = failures.join(verdicts.select("host", "rate", "host_failed"), "host", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_failed") & F.col("rule_failed")))


def op5_quality_rules(spark, sf_dir):
    out = apply_host_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, lower(coalesce(source, '')) AS src,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM base, unnest(range(1, len(w) - 1)) AS u(i)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, (VALUES (0), (1), (2)) AS t(k) GROUP BY rid),
feat AS (
  SELECT b.doc_id, CASE WHEN contains(src, '://') THEN regexp_extract(src, '://([^/?#:]*)', 1) ELSE src END AS host,
         CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM base b LEFT JOIN rep r USING (rid)),
f1 AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM feat),
f2 AS (SELECT *, base_failed OR 10 * n_symbols > word_chars OR 10 * n_dup_lines > 3 * n_lines
              OR word_chars > 12 * n_words OR word_chars < 2 * n_words AS rule_failed FROM f1),
h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE rule_failed) AS f FROM f2 GROUP BY host),
t AS (SELECT count(*) AS k, sum(n) AS n, sum(f) AS f, sum(f * f / n) AS ff, sum(n * n) AS nn FROM h),
m AS (SELECT f / n AS m, CASE WHEN f > 0 AND f < n THEN (ff - f * (f / n)) / ((f / n) * (1 - f / n)) - (k - 1) ELSE 0 END AS spread, n - nn / n - (k - 1) AS room FROM t),
p AS (SELECT m, CASE WHEN spread > 1e-9 AND room > 1e-9 THEN least(greatest(room / spread - 1, 1.0), 10000.0) ELSE 10000.0 END AS s FROM m),
verdict AS (SELECT host, (m * s + f) / (s + n) > 0.5 AS host_failed FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (host_failed AND rule_failed) AS kept
FROM f2 JOIN verdict USING (host)
"""
