"""Checks whose failures are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What the generation's columns may hold, which may not be null, and its keys.
ALLOWED = {
    ("run", "status"): ("succeeded", "failed"),
    ("call_site", "ref_kind"): ("call", "value", "macro"),
    ("call_site", "dispatch"): ("static", "virtual", "dynamic", "unknown"),
    ("call_target", "method"): ("declared", "cha", "rta", "vta", "jelly", "di-binding", "name-match", "lsp-impl"),
}
NOT_NULL = {
    "run": "run_id provider provider_version args started_at status source_tree".split(),
    "run_file": "run_id path edge_count".split(),
    "file": "path content_hash size".split(),
    "symbol": "id name kind modules external".split(),
    "call_site": "site_id run_id caller file line col ordinal ref_kind declared_target dispatch source".split(),
    "call_target": "site_id target method".split(),
}
KEYS = {"run": ["run_id"], "run_file": ["run_id", "path"], "file": ["path"], "symbol": ["id"], "call_site": ["site_id"]}
REFERENCES = [("run_file", "run_id", "run", "run_id"), ("call_site", "run_id", "run", "run_id"), ("call_target", "site_id", "call_site", "site_id")]


def check_index(documents: DataFrame, occurrences: DataFrame, sources: DataFrame) -> DataFrame:
    """error rows: no documents; or no occurrence although a source (path, declares) declares a function."""
    none = documents.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("no documents").alias("error"))
    empty = occurrences.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    example = sources.where("declares").agg(F.min("path").alias("path")).where("path IS NOT NULL")
    silent = empty.join(example, F.lit(True)).select(F.concat(F.lit("no occurrences, though a function is declared in "), "path").alias("error"))  # one row each
    return none.union(silent)


def check_edges(edges: DataFrame, references: DataFrame) -> DataFrame:
    """error rows: no edges although a document (path, callable) references a function; it names the first."""
    empty = edges.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    example = references.where("callable").agg(F.min("path").alias("path")).where("path IS NOT NULL")
    return empty.join(example, F.lit(True)).select(F.concat(F.lit("no call edges, though functions are referenced in "), "path").alias("error"))  # one row each


def check_resolved(sites: DataFrame) -> DataFrame:
    """error rows: there are called sites (called, reason) and every one is unresolved."""
    n = sites.agg(F.count_if("called").alias("called"), F.count_if(F.col("called") & F.col("reason").isNotNull()).alias("unresolved"))
    return n.where("called > 0 AND called = unresolved").select(F.concat(F.lit("all "), F.col("called").cast("string"), F.lit(" called names are unresolved")).alias("error"))


def check_call_graph(files: DataFrame, functions: DataFrame, sites: DataFrame, edges: DataFrame) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("k"), "n") for k, df in (("files", files), ("functions", functions), ("sites", sites), ("edges", edges))]
    n = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in ("files", "functions", "sites", "edges")])
    error = F.when(F.col("files") == 0, "no files").when((F.col("sites") > 0) & (F.col("functions") > 0) & (F.col("edges") == 0), "no function edges")
    return n.select(error.alias("error")).where("error IS NOT NULL")


def check_constraints(tables: dict[str, DataFrame]) -> DataFrame:
    """table, constraint, key of each violated key, reference, null or list of allowed values, for the tables and columns
    given. The key of `not null COLUMN` is how many rows have none."""
    out = []
    row = lambda df, table, rule, key: df.select(F.lit(table).alias("table"), rule.alias("constraint"), key.cast("string").alias("key"))
    for table, df in tables.items():
        if table in KEYS:
            twice = df.dropna(subset=KEYS[table]).groupBy(*KEYS[table]).count().where("count > 1")
            out.append(row(twice, table, F.lit("primary key"), F.concat_ws("/", *KEYS[table])))
        filled = [c for c in NOT_NULL.get(table, ()) if c in df.columns]
        nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in filled])  # one row: one scan counts all columns
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("n")) for c in filled])).alias("x")
        out.append(row(nulls.select(each).where("x.n > 0"), table, F.concat(F.lit("not null "), F.col("x.c")), F.col("x.n")))
    for table, column, parent, key in REFERENCES:
        if table in tables and parent in tables:
            missing = tables[table].where(F.col(column).isNotNull()).join(tables[parent].select(F.col(key).alias(column)).distinct(), column, "left_anti")
            out.append(row(missing.select(column).distinct(), table, F.lit(f"references {parent}"), F.col(column)))
    for (table, column), allowed in ALLOWED.items():
        if table in tables and column in tables[table].columns:
            out.append(row(tables[table].where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).select(column).distinct(), table, F.lit(f"check {column}"), F.col(column)))
    found = out[0]
    for df in out[1:]:
        found = found.union(df)
    return found


def check_declared_targets(site: DataFrame, target: DataFrame, method: str) -> DataFrame:
    """site_id of sites that don't have exactly one target, which is the declared one, by `method`."""
    rows = site.select("site_id", "declared_target").join(target, "site_id", "left").groupBy("site_id").agg(F.count("target").alias("n"), F.bool_and((F.col("target") == F.col("declared_target")) & (F.col("method") == method)).alias("same"))
    return rows.where((F.col("n") != 1) | ~F.coalesce("same", F.lit(False))).select("site_id")


def local_leaks(site: DataFrame, target: DataFrame, symbol: DataFrame) -> DataFrame:
    """Rows of any symbol column that still hold a local symbol; there must be none."""
    columns = [site.select(F.col("caller").alias("symbol")), site.select("declared_target"), target.select("target"), symbol.select("id")]
    out = columns[0]
    for c in columns[1:]:
        out = out.union(c)
    return out.where(F.col("symbol").startswith("local "))
