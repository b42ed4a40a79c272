"""Implementations as further targets of call sites, and listings of the call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def called_trait_methods(site: DataFrame, symbol: DataFrame, run: int) -> DataFrame:
    """symbol: distinct declared targets of a run that are trait methods of the project."""
    traits = symbol.where((F.col("kind") == "trait_method") & F.col("file").isNotNull()).select(F.col("id").alias("declared_target"))
    return site.where(F.col("run_id") == run).join(traits, "declared_target").select(F.col("declared_target").alias("symbol")).distinct()


def expand_targets(site: DataFrame, impls: DataFrame, symbol: DataFrame, run: int) -> DataFrame:
    """site_id, target, method: each implementation (method → implementation) is a target of every site of the run that
    declares the method. A method itself and unknown symbols are left out."""
    known = impls.select("method", "implementation").distinct().where("method <> implementation").join(symbol.select(F.col("id").alias("implementation")), "implementation", "left_semi")
    sites = site.where(F.col("run_id") == run).select("site_id", F.col("declared_target").alias("method"))
    return sites.join(known, "method").select("site_id", F.col("implementation").alias("target"), F.lit("lsp-impl").alias("method")).distinct()


def unmapped_answers(answers: DataFrame, located: DataFrame, symbol: DataFrame) -> DataFrame:
    """Answers (ref_id, …) whose position maps to no definition that the generation knows."""
    known = located.join(symbol.select(F.col("id").alias("symbol")), "symbol", "left_semi").select("ref_id")
    return answers.join(known, "ref_id", "left_anti")


def expansion_summary(targets: DataFrame, methods: DataFrame) -> DataFrame:
    """One row: methods asked, distinct implementations, target rows, distinct sites."""
    asked = methods.select(F.lit(1).alias("m"), F.lit(None).cast("string").alias("t"), F.lit(None).cast("long").alias("s"))
    rows = targets.select(F.lit(0).alias("m"), F.col("target").alias("t"), F.col("site_id").alias("s"))
    return asked.union(rows).agg(F.sum("m").alias("methods"), F.countDistinct("t").alias("implementations"), F.count("t").alias("target_rows"), F.countDistinct("s").alias("sites"))


def candidate_count(target: DataFrame) -> DataFrame:
    return target.withColumn("candidates", F.count(F.lit(1)).over(Window.partitionBy("site_id", "method")))


def list_call_sites(site: DataFrame, symbol: DataFrame) -> DataFrame:
    names = symbol.select("id", "name")
    callers, targets = names.toDF("caller", "caller_name"), names.toDF("declared_target", "target_name")
    return site.join(callers, "caller").join(targets, "declared_target").select("site_id", "file", "line", "col", "caller_name", "target_name")


def list_call_targets(site: DataFrame, target: DataFrame, symbol: DataFrame) -> DataFrame:
    """site_id, file, line, caller_name, target_name, method, candidates. Targets are dealt by site once, for the window and
    the join."""
    names = symbol.select("id", "name")
    rows = candidate_count(target.repartition("site_id")).join(site.select("site_id", "file", "line", "caller"), "site_id")
    return rows.join(names.toDF("caller", "caller_name"), "caller").join(names.toDF("target", "target_name"), "target").select("site_id", "file", "line", "caller_name", "target_name", "method", "candidates")


def implementers(symbol_info: DataFrame) -> DataFrame:
    """symbol, implemented: pairs of implementation relationships."""
    each = symbol_info.select("symbol", F.explode("relationships").alias("r")).where("r.is_implementation")
    return each.select("symbol", F.col("r.symbol").alias("implemented")).distinct()


def calls_reach(edges: DataFrame) -> DataFrame:
    """file, line → the sorted functions that calls there reach. edges: file, line, callee, callee_kind."""
    return edges.where("callee_kind = 'function'").groupBy("file", "line").agg(F.sort_array(F.collect_set("callee")).alias("callees"))


def module_loads(edges: DataFrame) -> DataFrame:
    return edges.where("callee_kind = 'module'").select("file", "line", "callee").distinct()


def has_edge(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: file, line, callee → adds `found`."""
    there = edges.select("file", "line", "callee").distinct().withColumn("found", F.lit(True))
    return wanted.join(there, ["file", "line", "callee"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def ingest_summary(files: DataFrame, symbols: DataFrame, sites: DataFrame, skipped: DataFrame, collisions: DataFrame) -> DataFrame:
    """One row of counts: files, symbols, call_sites, skipped, collisions."""
    parts = {"files": files, "symbols": symbols, "call_sites": sites, "skipped": skipped, "collisions": collisions}
    rows = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("what"))
        rows = one if rows is None else rows.union(one)
    return rows.agg(*[F.count_if(F.col("what") == n).alias(n) for n in parts])
