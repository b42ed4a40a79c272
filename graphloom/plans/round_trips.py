"""Registered queries of sources, sinks and streams: each writes data that Spark derives from the driver's tables to the
shared folder, and reads it back through the source or stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.functions.frames import shared_folder
from graphloom.plans.inputs import oracle
from graphloom.sources import readers, snapshots
from graphloom.streaming import coalesce


def folder(r, name: str) -> str:
    return f"{shared_folder(r('region').sparkSession)}/{name}-{uuid.uuid4().hex}"


def nested_index(r):
    """Occurrences as the nested documents that an indexer gives."""
    occ = r("occurrence").withColumn("range", F.array("line", "character", F.col("character") + 3))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol", "range", F.lit(None).cast("array<int>").alias("enclosing_range"), "roles"))), lambda x: F.struct(x["symbol"].alias("symbol"), x["range"].alias("range"), x["enclosing_range"].alias("enclosing_range"), x["roles"].alias("roles")))
    info = F.expr("cast(array() as array<struct<symbol:string, kind:string, relationships:array<struct<symbol:string, is_implementation:boolean, is_reference:boolean, is_type_definition:boolean, is_definition:boolean>>>>)")
    return occ.groupBy(F.concat(F.lit("src\\"), "path").alias("relative_path")).agg(rows.alias("occurrences")).withColumn("doc_pos", F.lit(0)).withColumn("symbols", info)


def flatten_index(r):
    occ, _ = readers.flatten_index(nested_index(r))
    return occ.select("path", "pos", "symbol", F.col("range")[0].alias("line"), "roles")


def jsonl(r):
    to = folder(r, "jsonl")
    r("call_site").select("site_id", "caller", "line").write.json(to)
    return readers.read_jsonl_strict(r("region").sparkSession, to, "site_id long, caller string, line int")


def call_graph(r):
    """One graph per customer: functions are orders, calls are lines of orders."""
    o = r("orders").select("o_custkey", "o_orderkey")
    place = F.concat_ws(":", F.lit("0"), *[F.col("o_orderkey") % k + 1 for k in (97, 31, 89, 29)])
    graphs = o.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("o_orderkey").cast("string"), place))).alias("functions"), F.collect_list(F.array("o_orderkey", "o_orderkey")).alias("call2fun"))
    rows = graphs.select(F.to_json(F.struct(F.array(F.concat(F.lit("c"), "o_custkey")).alias("files"), "functions", F.col("functions").alias("calls"), "call2fun")).alias("value"))
    got = readers.read_call_graph_maps(rows)
    return got["functions"].select("path", "id", "is_module", "start_line", "start_character")


def call_graph_of_all(r):
    """All orders as functions, in one graph per 256 order keys, so that no graph grows with the input."""
    o = r("orders").select("o_orderkey", F.expr("o_orderkey DIV 256").alias("bucket"))
    place = F.concat_ws(":", F.lit("0"), *[F.col("o_orderkey") % k + 1 for k in (97, 31, 89, 29)])
    graphs = o.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct(F.col("o_orderkey").cast("string"), place))).alias("functions"), F.collect_list(F.array("o_orderkey", "o_orderkey")).alias("call2fun"))
    rows = graphs.select(F.to_json(F.struct(F.array(F.concat(F.lit("b"), "bucket")).alias("files"), "functions", F.col("functions").alias("calls"), "call2fun")).alias("value"))
    return readers.read_call_graph_maps(rows)["functions"].select("path", "id", "is_module", "start_line", "start_character")


def session_log(r):
    to = folder(r, "session")
    m = r("log_message").withColumn("from", F.col("sender"))
    m.select("ts_ms", "from", "kind", "method", "id", "bytes").write.json(to)
    messages, _ = readers.read_session_log(r("region").sparkSession, to)
    return messages.select("ts_ms", "sender", "kind", "method", "id", "bytes")


def baseline(r):
    to = folder(r, "baseline")
    snapshots.write_text(readers.edge_baseline_text(r("edges_by_year").select(F.concat_ws("@", "provider", "generation").alias("provider"), "path", "edge_count")), to)
    return readers.read_edge_baseline(r("region").sparkSession.read.text(to, wholetext=True))


def files(r):
    """Regions' names as files, one per region."""
    to = folder(r, "files")
    r("nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "\n").alias("value")).write.partitionBy("n_regionkey").text(to)
    got = readers.file_table(r("region").sparkSession, to, {".txt": "text"})
    return got.select(F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("int").alias("region"), "language", "content_hash", "size")


def generation(r):
    spark, root = r("region").sparkSession, folder(r, "generations")
    site = r("call_site").selectExpr("site_id", "run_id", "caller", "file", "line", "col", "0 AS ordinal", "ref_kind", "cast(null as string) AS receiver_text", "declared_target", "dispatch", "cast(null as string) AS source")
    snapshots.publish_generation(spark, {"call_site": site.limit(0), "call_target": r("call_target").limit(0)}, root)
    snapshots.publish_generation(spark, {"call_site": site, "call_target": r("call_target")}, root)
    now = snapshots.read_generation(spark, root)
    return now["call_target"].join(now["call_site"].select("site_id", "file"), "site_id")


def appended_targets(r):
    to = folder(r, "targets")
    snapshots.write_call_targets(r("call_target").where("method = 'declared'").withColumn("run_id", F.lit(1)), to)
    snapshots.write_call_targets(r("call_target").where("method <> 'declared'").withColumn("run_id", F.lit(2)), to)
    return r("region").sparkSession.read.parquet(to).groupBy("run_id").agg(F.count(F.lit(1)).alias("targets"))


def streamed(r, events, run, schema: str):
    """The rows that a stream over `events`, read from written files in one go, gives."""
    spark, at = events.sparkSession, folder(r, "stream")
    events.write.parquet(f"{at}/in")
    stream = run(spark.readStream.schema(events.schema).parquet(f"{at}/in"))
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out")


def filtered_stream(r):
    events = r("change_event").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("path", F.when(F.col("event_id") % 50 == 0, ".git/index.lock").otherwise(F.substring("path", 2, 99)))
    return streamed(r, events, lambda s: coalesce.filter_stream(s, ["p1"], ["p7"]).select("event_id", "path", "kind"), "event_id long, path string, kind string")


ENTRIES = {
    "flatten_index": (flatten_index, "SELECT concat('src/', path) AS path, CAST(row_number() OVER (PARTITION BY path ORDER BY pos) - 1 AS INT) AS pos, symbol, line, roles FROM {occurrence}"),
    "read_jsonl_strict": (jsonl, "SELECT site_id, caller, line FROM {call_site}"),
    "read_call_graph_maps": (call_graph, "SELECT concat('c', o_custkey) AS path, o_orderkey AS id, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS is_module, CAST(o_orderkey % 97 AS INT) AS start_line, CAST(o_orderkey % 31 AS INT) AS start_character FROM {orders}"),
    "read_call_graph_maps_of_all": (call_graph_of_all, "SELECT concat('b', o_orderkey // 256) AS path, o_orderkey AS id, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_orderkey // 256) AS is_module, CAST(o_orderkey % 97 AS INT) AS start_line, CAST(o_orderkey % 31 AS INT) AS start_character FROM {orders}"),
    "read_session_log": (session_log, "SELECT ts_ms, sender, kind, method, concat('\"', id, '\"') AS id, bytes FROM {log_message}"),
    "edge_baseline": (baseline, "SELECT concat(provider, '@', generation) AS provider, path, edge_count FROM {edges_by_year}"),
    "file_table": (files, "SELECT n_regionkey AS region, 'text' AS language, concat('sha256:', sha256(s)) AS content_hash, CAST(length(s) AS BIGINT) AS size FROM (SELECT n_regionkey, concat(string_agg(n_name, chr(10) ORDER BY n_name), chr(10)) AS s FROM {nation} GROUP BY n_regionkey)"),
    "publish_generation": (generation, "SELECT t.site_id, t.target, t.method, s.file FROM {call_target} t JOIN {call_site} s ON s.site_id = t.site_id"),
    "write_call_targets": (appended_targets, "SELECT CAST(CASE WHEN method = 'declared' THEN 1 ELSE 2 END AS INT) AS run_id, count(*) AS targets FROM {call_target} GROUP BY 1"),
    "filter_stream": (filtered_stream, "SELECT event_id, path, CASE WHEN path = '.git/index.lock' THEN CASE WHEN kind = 'deleted' THEN 'unlock' ELSE 'lock' END ELSE kind END AS kind FROM (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN '.git/index.lock' ELSE substr(path, 2) END AS path, kind FROM {change_event}) WHERE path NOT IN ('p1', 'p7')"),
}


def oracle_sql() -> dict:
    return {name: oracle(sql) for name, (_, sql) in ENTRIES.items() if sql}
