"""Registered queries over file changes and bursts of them: coalescing and the guard, in a stream and in a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions.frames import checkpointed, dealer
from graphloom.operators import changes, graph_views
from graphloom.plans.inputs import oracle
from graphloom.plans.round_trips import folder, streamed
from graphloom.streaming import coalesce, guards

#: Quiet window, longest wait and cap of a lock, in milliseconds.
WINDOWS = (60_000, 600_000, 1_800_000)
#: One step per event and root: what falls due before the event is flushed, then the event is taken.
COALESCED = """WITH RECURSIVE e AS (SELECT root, epoch_us(ts) // 1000 AS t, path, kind, found, row_number() OVER (PARTITION BY root ORDER BY epoch_us(ts) // 1000, event_id, path, kind) AS n FROM {watch_event}),
  s AS (SELECT root, CAST(0 AS BIGINT) AS n, NONE AS p, CAST(NULL AS BIGINT) AS f, CAST(NULL AS BIGINT) AS l, CAST(NULL AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS c, CAST([] AS STRUCT(at_ms BIGINT, cause VARCHAR, changes MAP(VARCHAR, VARCHAR))[]) AS flushes FROM (SELECT DISTINCT root FROM e)
    UNION ALL SELECT root, n, p2, CASE WHEN released THEN NULL WHEN NOT touched THEN f1 WHEN cardinality(p2) > 0 OR c2 IS NOT NULL THEN coalesce(f1, t) END,
      CASE WHEN released THEN NULL WHEN NOT touched THEN l1 WHEN cardinality(p2) > 0 OR c2 IS NOT NULL THEN t END, CASE kind WHEN 'lock' THEN coalesce(k, t) WHEN 'unlock' THEN NULL ELSE k END, c2,
      list_concat(CASE WHEN flushed THEN [{'at_ms': due, 'cause': c, 'changes': p}] ELSE [] END, CASE WHEN released THEN [{'at_ms': t, 'cause': c1, 'changes': p1}] ELSE [] END)
    FROM (SELECT *, CASE WHEN released THEN NULL WHEN kind = 'rescan' THEN path ELSE c1 END AS c2,
        CASE WHEN released THEN NONE WHEN kind = 'rescan' THEN CASE WHEN found IS NULL THEN NONE ELSE map_from_entries(list_transform(string_split(found, ','), lambda x: {'k': string_split(x, '=')[1], 'v': string_split(x, '=')[2]})) END
          WHEN NOT touched THEN p1 WHEN was = 'created' AND kind = 'deleted' THEN map_from_entries(list_filter(map_entries(p1), lambda x: x.key <> path))
          ELSE map_concat(p1, MAP {path: CASE WHEN was = 'created' THEN 'created' WHEN was = 'deleted' AND kind = 'created' THEN 'changed' ELSE kind END}) END AS p2
      FROM (SELECT *, map_extract(p1, path)[1] AS was, kind NOT IN ('lock', 'unlock') AS touched, kind = 'unlock' AND k IS NOT NULL AND (cardinality(p1) > 0 OR c1 IS NOT NULL) AS released
        FROM (SELECT *, CASE WHEN flushed THEN NONE ELSE p END AS p1, CASE WHEN NOT flushed THEN f END AS f1, CASE WHEN NOT flushed THEN l END AS l1, CASE WHEN NOT flushed THEN c END AS c1
          FROM (SELECT *, coalesce(due <= t, FALSE) AS flushed FROM (SELECT e.*, s.p, s.f, s.l, s.k, s.c, DUE AS due FROM s JOIN e ON e.root = s.root AND e.n = s.n + 1)))))),
  b AS (SELECT root, unnest(flushes) AS x FROM s UNION ALL SELECT root, {'at_ms': DUE, 'cause': c, 'changes': p} FROM s WHERE n = (SELECT max(n) FROM e WHERE e.root = s.root) AND DUE IS NOT NULL)
  SELECT root, x.at_ms AS flushed_ms, x.cause AS cause, y.k AS path, y.v AS kind FROM (SELECT root, x, unnest(CASE WHEN cardinality(x.changes) = 0 THEN [{'k': NULL, 'v': NULL}] ELSE list_transform(map_entries(x.changes), lambda m: {'k': m.key, 'v': m.value}) END) AS y FROM b)"""
COALESCED = COALESCED.replace("NONE", "CAST(MAP {} AS MAP(VARCHAR, VARCHAR))").replace("DUE", "CASE WHEN cardinality(s.p) > 0 OR s.c IS NOT NULL THEN greatest(least(s.l + %d, s.f + %d), coalesce(s.k + %d, 0)) END" % WINDOWS)


def watched(r):
    """Changes, locks and rescans, with the changes that a rescan found."""
    found = F.transform(F.split("found", ","), lambda x: F.struct(F.split(x, "=")[0].alias("path"), F.split(x, "=")[1].alias("kind")))
    return r("watch_event").withColumn("diff", found).withColumn("ts", F.col("ts").cast("timestamp"))


def coalesce_stream(r):
    """All events, and one of another root an hour after the last, which passes the watermark over them."""
    events = watched(r).select("root", "ts", "event_id", "path", "kind", "diff")
    end = events.agg(F.max("ts").alias("ts")).select(F.lit("end").alias("root"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit("").alias("path"), F.lit("unlock").alias("kind"), F.lit(None).cast(coalesce.DIFF).alias("diff"))
    return coalesce.batches(streamed(r, events.unionByName(end), lambda s: coalesce.coalesce_stream(s, *WINDOWS), coalesce.OUTPUT))


#: Half-life in seconds, and the count at which the guard trips.
GUARD = (86_400.0, 3.0)
#: Each op with the count before it, by all pairs of an actor's ops; rank is the order of ops.
GUARDED = """WITH o AS (SELECT user_id, event_id, TIME AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM {events}),
  c AS (SELECT b.user_id, b.event_id, b.t, b.n, sum(pow(2.0, -(b.t - a.t) / 86400.0)) AS c FROM o a JOIN o b ON b.user_id = a.user_id AND a.n <= b.n GROUP BY ALL),
  g AS (SELECT *, coalesce(max(CASE WHEN c >= 3.0 THEN n END) OVER w, 0) AS tripped_at, coalesce(max(CASE WHEN c - 1 < 0.75 THEN n END) OVER w, 0) AS cleared_at FROM c WINDOW w AS (PARTITION BY user_id ORDER BY n))
  """
BY_US, BY_MS = GUARDED.replace("TIME", "epoch_us(ts) / 1e6"), GUARDED.replace("TIME", "(epoch_us(ts) // 1000) / 1e3")


def ops(r):
    return r("events").select(F.col("user_id").alias("actor"), F.col("ts").cast("timestamp").cast("double").alias("ts"), F.col("event_id").alias("op_id"))


def guard_stream(r):
    rows = r("events").select(F.col("user_id").cast("string").alias("actor"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("op_id"))
    return streamed(r, rows, lambda s: guards.decay_guard(s, GUARD[0] * 1000, GUARD[1]), "actor string, ts_ms long, c double, tripped boolean").withColumn("c", F.round("c", 6))


def baseline_stream(r):
    """The changes between two snapshots as flushed batches, two micro-batches of them, applied to the first snapshot. A
    batch is written and read by many tasks; a micro-batch takes as many files as the larger of the two has."""
    spark, at, deal = r("region").sparkSession, folder(r, "baselines"), dealer(r("customer"))
    found = changes.snapshot_diff(deal(r("snapshot_old"), "path"), deal(r("snapshot_new"), "path"))
    flushed = checkpointed(found.select(F.lit("r").alias("root"), (F.crc32("path") % 2).alias("flushed_ms"), F.lit(None).cast("string").alias("cause"), "path", "kind"))
    for n in range(2):
        flushed.where(f"flushed_ms = {n}").write.parquet(f"{at}/in/{n}")
    files = max(1, *[len(spark.read.schema(coalesce.BATCH).parquet(f"{at}/in/{n}").inputFiles()) for n in range(2)])
    stream = spark.readStream.schema(coalesce.BATCH).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(f"{at}/in")
    coalesce.write_baselines(stream, f"{at}/out", r("snapshot_new"), f"{at}/state", start=r("snapshot_old")).trigger(availableNow=True).start().awaitTermination()
    return coalesce.read_baseline(spark, f"{at}/out")


#: What stays is in both, as a directory; all else is as the new snapshot has it.
BASELINE = "SELECT b.path, CASE WHEN a.is_dir AND b.is_dir THEN a.is_dir ELSE b.is_dir END AS is_dir, CASE WHEN a.is_dir AND b.is_dir THEN a.len ELSE b.len END AS len, CASE WHEN a.is_dir AND b.is_dir THEN a.modified ELSE b.modified END AS modified FROM {snapshot_new} b LEFT JOIN {snapshot_old} a ON a.path = b.path"

ENTRIES = {
    "coalesce_batch": (lambda r: coalesce.coalesce_batch(watched(r), *WINDOWS), COALESCED),
    "coalesce_stream": (coalesce_stream, COALESCED),
    "baseline_stream": (baseline_stream, BASELINE),
    "guarded_ops": (lambda r: graph_views.guarded(ops(r), *GUARD).select("actor", "op_id", F.round("c", 6).alias("c"), "tripped"), f"{BY_US} SELECT user_id AS actor, event_id AS op_id, round(c, 6) AS c, tripped_at > 0 AND tripped_at >= cleared_at AS tripped FROM g"),
    "decay_guard": (lambda r: graph_views.decay_guard(ops(r), *GUARD).withColumn("c", F.round("c", 6)), f"{BY_US} SELECT user_id AS actor, max(n) AS ops, round(max_by(c, n), 6) AS c, max_by(tripped_at > 0 AND tripped_at >= cleared_at, n) AS tripped FROM g GROUP BY user_id"),
    "guard_stream": (guard_stream, f"{BY_MS} SELECT CAST(user_id AS VARCHAR) AS actor, CAST(round(t * 1000) AS BIGINT) AS ts_ms, round(c, 6) AS c, tripped_at > 0 AND tripped_at >= cleared_at AS tripped FROM g"),
}


def oracle_sql() -> dict:
    return {name: oracle(sql) for name, (_, sql) in ENTRIES.items() if sql}
