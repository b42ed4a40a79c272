"""Snapshots (generations) of the code index: hashes, first-writer inserts, removal of a file, carry-over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def source_tree_hash(files: DataFrame, by: str | None = None) -> DataFrame:
    """source_tree: sha256 of `path hash` lines ordered by path, per `by` or for all files; of nothing for none."""
    line = F.concat_ws(" ", "path", "content_hash")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"])
    groups = files.groupBy(by) if by else files.groupBy()
    return groups.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("source_tree"))


def insert_if_absent(target: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The target with rows of `new` whose key it lacks; of several new rows with one key, the first in order."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
    return target.unionByName(first.join(target.select(*key), key, "left_anti").select(*target.columns))


def generation_without(tables: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """The tables without a file, its symbols, its sites, and their targets."""
    out = dict(tables)
    out["file"] = tables["file"].where(F.col("path") != path)
    out["symbol"] = tables["symbol"].where(~F.coalesce(F.col("file") == path, F.lit(False)))
    out["call_site"] = tables["call_site"].where(F.col("file") != path)
    gone = tables["call_site"].where(F.col("file") == path).select("site_id")
    out["call_target"] = tables["call_target"].join(gone, "site_id", "left_anti")
    return out


def carry_forward(previous: DataFrame, old_files: DataFrame, new_files: DataFrame, column: str = "file") -> DataFrame:
    """Rows of files whose content didn't change, to copy into the next generation."""
    same = old_files.select("path", "content_hash").join(new_files.select("path", "content_hash"), ["path", "content_hash"]).select(F.col("path").alias(column))
    return previous.join(same, column, "left_semi")


def distinct_sources(site: DataFrame) -> DataFrame:
    return site.select("source").distinct()
