"""Resolution rates of call sites and edge counts of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A guess by name: it resolves nothing.
NAME_MATCH = "name-match"


def resolved_flag(site: DataFrame, target: DataFrame) -> DataFrame:
    """Adds `resolved`: whether the site has a target that isn't a guess by name."""
    known = target.where(F.col("method") != NAME_MATCH).select("site_id").distinct().withColumn("resolved", F.lit(True))
    return site.join(known, "site_id", "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def site_dimensions(site: DataFrame, file: DataFrame, symbol: DataFrame) -> DataFrame:
    """Adds language, package and module; null where the file or the caller isn't known."""
    languages = file.select(F.col("path").alias("file"), "language")
    callers = symbol.select(F.col("id").alias("caller"), "package", "module")
    return site.join(languages, "file", "left").join(callers, "caller", "left")


def unresolved_rate(call_sites, unresolved):
    """Share of unresolved sites; null where there are none."""
    return F.try_divide(unresolved.cast("double"), call_sites.cast("double"))


def resolution_by_module(site: DataFrame, target: DataFrame, file: DataFrame, symbol: DataFrame) -> DataFrame:
    """language, package, module, call_sites, resolved, unresolved. Null dimensions are groups of their own. Sites are summed
    by caller and file once it is known which are resolved, so the dimensions are joined to sums and not to sites."""
    sums = resolved_flag(site, target).groupBy("file", "caller").agg(F.count(F.lit(1)).alias("call_sites"), F.count_if("resolved").alias("resolved"))
    out = site_dimensions(sums, file, symbol).groupBy("language", "package", "module").agg(F.sum("call_sites").alias("call_sites"), F.sum("resolved").alias("resolved"))
    return out.withColumn("unresolved", F.col("call_sites") - F.col("resolved"))


def resolution_rollup(by_module: DataFrame) -> DataFrame:
    """level (language or total), language, sums and rate. grouping_id tells a total from the null language."""
    total = by_module.rollup("language").agg(F.grouping_id().alias("g"), *[F.sum(c).alias(c) for c in ("call_sites", "resolved", "unresolved")])
    level = F.when(F.col("g") == 0, "language").otherwise("total")
    return total.select(level.alias("level"), "language", "call_sites", "resolved", "unresolved", unresolved_rate(F.col("call_sites"), F.col("unresolved")).alias("rate"))


def order_report(by_module: DataFrame) -> DataFrame:
    return by_module.orderBy(F.asc_nulls_last("language"), F.asc_nulls_last("package"), F.asc_nulls_first("module"))


def edge_counts(run: DataFrame, run_file: DataFrame) -> DataFrame:
    """provider, path, edge_count over all runs."""
    return run_file.join(run.select("run_id", "provider"), "run_id").groupBy("provider", "path").agg(F.sum("edge_count").cast("long").alias("edge_count"))


def run_file_counts(file: DataFrame, site: DataFrame) -> DataFrame:
    """path, edge_count: sites per file, zero for files with none."""
    counted = site.groupBy(F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("edge_count"))
    return file.select("path").join(counted, "path", "left").withColumn("edge_count", F.coalesce("edge_count", F.lit(0)))


def run_edges_per_file(run_file: DataFrame, base_run: int, site: DataFrame, target: DataFrame, run: int) -> DataFrame:
    """path, edge_count: targets of run's sites per file of the base run, zero-filled."""
    found = site.where(F.col("run_id") == run).join(target, "site_id").groupBy(F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    files = run_file.where(F.col("run_id") == base_run).select("path").distinct()
    return files.join(found, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("edge_count"))


def inherit_source_tree(run: DataFrame, run_id: int, base_run: int) -> DataFrame:
    """The runs, with run_id's source tree taken from the base run."""
    base = run.where(F.col("run_id") == base_run).select(F.lit(run_id).alias("run_id"), F.col("source_tree").alias("inherited"))
    return run.join(F.broadcast(base), "run_id", "left").withColumn("source_tree", F.coalesce("inherited", "source_tree")).drop("inherited")  # one row


def unresolved_by_module(site: DataFrame, target: DataFrame, symbol: DataFrame) -> DataFrame:
    """module, unresolved, call_sites for every module, also those without a site."""
    callers = symbol.select(F.col("id").alias("caller"), "module")
    per = resolved_flag(site, target).join(callers, "caller").groupBy("module").agg(F.count_if(~F.col("resolved")).alias("unresolved"), F.count(F.lit(1)).alias("call_sites"))
    modules = symbol.select("module").where("module IS NOT NULL").distinct()
    zero = F.lit(0).cast("long")
    return modules.join(per, "module", "left").select("module", F.coalesce("unresolved", zero).alias("unresolved"), F.coalesce("call_sites", zero).alias("call_sites"))


def unresolved_list(site: DataFrame, target: DataFrame, symbol: DataFrame) -> DataFrame:
    """module, file, line, caller, declared_target, dispatch, candidates: the sites that unresolved_by_module counts, with
    how many guesses each has; sort by module, file and line to print them."""
    guesses = target.groupBy("site_id").agg(F.count(F.lit(1)).alias("candidates"), F.bool_or(F.col("method") != "name-match").alias("known"))
    callers = symbol.select(F.col("id").alias("caller"), "module")
    rows = site.join(guesses, "site_id", "left").where("NOT coalesce(known, false)").join(callers, "caller").where("module IS NOT NULL")
    return rows.select("site_id", "module", "file", "line", "caller", "declared_target", "dispatch", F.coalesce("candidates", F.lit(0)).alias("candidates"))
