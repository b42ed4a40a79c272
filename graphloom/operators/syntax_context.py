"""Syntax context of call sites over a table of nodes (file, node_id, parent_id, kind, field, start, end_at)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a bucket for the range join of sites and nodes.
BUCKET_BYTES = 2048


def enclosing(sites: DataFrame, nodes: DataFrame, bucket: int = BUCKET_BYTES) -> DataFrame:
    """Each site (site_id, file, at) with the nodes whose [start, end_at) holds it. Nodes are copied to the buckets that
    they touch, so files of any size are dealt to many tasks."""
    dealt = nodes.where("end_at > start").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end_at") - 1) / bucket)))).withColumnRenamed("file", "node_file")
    met = (F.col("file") == F.col("node_file")) & (F.floor(F.col("at") / bucket) == F.col("bucket")) & (F.col("start") <= F.col("at")) & (F.col("at") < F.col("end_at"))
    return sites.join(dealt, met).drop("bucket", "node_file")


def control_context(sites: DataFrame, nodes: DataFrame, kinds: DataFrame, definitions: tuple[str, ...]) -> DataFrame:
    """site_id, controls: the controls around each site below its innermost definition, innermost first. kinds: kind,
    control, and, where a kind counts only if it is entered through some of its fields, `mode` (only, except) and
    `fields`; the field is that of the child on the way in."""
    around = enclosing(sites, nodes)
    depth = F.struct("start", (-F.col("end_at")).alias("e"))
    inner = around.where(F.col("kind").isin(*definitions)).groupBy("site_id").agg(F.max(depth).alias("definition"))
    rows = around.join(inner, "site_id", "left").where(F.col("definition").isNull() | (depth > F.col("definition"))).join(kinds, "kind")
    if {"mode", "fields"} <= set(kinds.columns):
        way = around.select("site_id", F.col("parent_id").alias("node_id"), F.col("field").alias("entered"))
        rows = rows.join(way, ["site_id", "node_id"], "left")
        named = F.coalesce(F.array_contains("fields", F.col("entered")), F.lit(False))
        rows = rows.where((F.coalesce("mode", F.lit("all")) == "all") | ((F.col("mode") == "only") & named) | ((F.col("mode") == "except") & ~named))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("start")).alias("s"), "end_at", "node_id", "control")))  # as deep as the nesting
    found = rows.groupBy("site_id").agg(F.transform(ordered, lambda x: x["control"]).alias("controls"))
    return sites.select("site_id").join(found, "site_id", "left").withColumn("controls", F.coalesce("controls", F.expr("cast(array() as array<string>)")))


def site_call(sites: DataFrame, nodes: DataFrame, calls: tuple[str, ...], callee: DataFrame | None = None) -> DataFrame:
    """site_id, call: the innermost call node around each name. With `callee` (node_id, start, end_at of the callee), it
    is the site's call only if the name lies in its callee."""
    around = enclosing(sites, nodes.where(F.col("kind").isin(*calls)))
    best = around.groupBy("site_id").agg(F.max(F.struct("start", (-F.col("end_at")).alias("e"), "node_id", "at")).alias("x")).select("site_id", F.col("x.node_id").alias("call"), F.col("x.at").alias("at"))
    if callee is None:
        return best.select("site_id", "call")
    part = callee.select(F.col("node_id").alias("call"), F.col("start").alias("cs"), F.col("end_at").alias("ce"))
    return best.join(part, "call").where("cs <= at AND at < ce").select("site_id", "call")


def literal_arguments(calls: DataFrame, nodes: DataFrame, strings: tuple[str, ...], interpolation: tuple[str, ...]) -> DataFrame:
    """call, literals: direct string arguments in order, unquoted; interpolated strings are left out. nodes have `text`."""
    from graphloom.functions.text import unquote_literal

    direct = nodes.where(F.col("kind").isin(*strings)).join(calls.select(F.col("call").alias("parent_id")).distinct(), "parent_id", "left_semi")
    mixed = nodes.where(F.col("kind").isin(*interpolation)).select(F.col("parent_id").alias("node_id")).distinct()
    plain = direct.join(mixed, "node_id", "left_anti")
    ordered = F.array_sort(F.collect_list(F.struct("start", unquote_literal(F.col("text")).alias("t"))))  # as many as a call has
    return plain.groupBy(F.col("parent_id").alias("call")).agg(F.transform(ordered, lambda x: x["t"]).alias("literals"))
