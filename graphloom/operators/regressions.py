"""Edge counts of two snapshots: drops, differences, and their text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A fall of more than so many per cent is a drop.
DROP_PERCENT = 50


def is_drop(previous: Column, current: Column) -> Column:
    fall = (previous - current) * 100 > previous * DROP_PERCENT
    return F.when(previous <= 0, False).when(current <= 0, True).otherwise(fall)


def edge_regressions(previous: DataFrame, current: DataFrame, existing: DataFrame) -> DataFrame:
    """provider, path, previous, current (null: no count) of dropped files. A file that lost its count is a drop only
    if it had edges and still exists."""
    now = current.select("provider", "path", F.col("edge_count").alias("current"))
    there = existing.select("path").distinct().withColumn("exists", F.lit(True))
    rows = previous.select("provider", "path", F.col("edge_count").alias("previous")).join(now, ["provider", "path"], "left").join(there, "path", "left")
    dropped = F.when(F.col("current").isNotNull(), is_drop(F.col("previous"), F.col("current"))).otherwise((F.col("previous") > 0) & F.col("exists").isNotNull())
    return rows.where(dropped).select("provider", "path", "previous", "current")


def edge_diff(expected: DataFrame, found: DataFrame) -> DataFrame:
    """provider, path, expected, found where they differ, or where only one side has a count."""
    left = expected.select("provider", "path", F.col("edge_count").alias("expected"))
    right = found.select("provider", "path", F.col("edge_count").alias("found"))
    return left.join(right, ["provider", "path"], "full").where(~F.col("expected").eqNullSafe(F.col("found")))


def previous_generation(generations: DataFrame) -> DataFrame:
    """Adds `previous`, the largest complete number below each. A window over the list of generations, which is short."""
    before = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return generations.withColumn("previous", F.max(F.when(F.col("complete"), F.col("n"))).over(before))


def retention(generations: DataFrame, keep: int = 2) -> DataFrame:
    """Adds `kept`: the newest `keep` complete generations stay, all else goes."""
    newest = F.row_number().over(Window.partitionBy("complete").orderBy(F.desc("n")))
    return generations.withColumn("kept", F.col("complete") & (newest <= keep))


def report_passed(drops: DataFrame, differences: DataFrame) -> DataFrame:
    """One row: passed, when there are neither drops nor differences."""
    n = drops.select(F.lit(1).alias("x")).union(differences.select(F.lit(1).alias("x"))).agg(F.count("x").alias("n"))
    return n.select((F.col("n") == 0).alias("passed"))


def drop_lines(drops: DataFrame) -> DataFrame:
    now = F.coalesce(F.col("current").cast("string"), F.lit("none"))
    return drops.select("provider", "path", F.concat_ws("", F.lit("drop "), "provider", F.lit(" "), "path", F.lit(": "), F.col("previous").cast("string"), F.lit(" -> "), now).alias("line"))


def diff_lines(differences: DataFrame) -> DataFrame:
    """`- ` lines for what was expected and `+ ` lines for what was found."""
    sides = F.array(F.struct(F.lit("-").alias("sign"), F.col("expected").alias("n")), F.struct(F.lit("+").alias("sign"), F.col("found").alias("n")))
    rows = differences.select("provider", "path", F.explode(sides).alias("x")).where("x.n IS NOT NULL")
    return rows.select("provider", "path", F.concat_ws("", "x.sign", F.lit(" "), "provider", F.lit(" "), "path", F.lit(" "), F.col("x.n").cast("string")).alias("line"))


def resolution_lines(rollup: DataFrame) -> DataFrame:
    rate = F.when(F.col("rate").isNull(), "-").otherwise(F.format_string("%.1f%%", F.col("rate") * 100))
    name = F.when(F.col("level") == "total", "total").otherwise(F.coalesce("language", F.lit("unknown")))
    return rollup.select(F.concat_ws(" ", name, F.col("call_sites").cast("string"), F.col("unresolved").cast("string"), rate).alias("line"))
