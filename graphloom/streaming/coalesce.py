"""Coalescing of file changes, with keyed state per root.

Events are (root, ts, event_id, path, kind, diff), kind being created, changed, deleted, lock, unlock or rescan. A root's
pending changes are merged per path and flushed when `quiet` has passed since the last or `max_wait` since the first. While
a lock is held nothing is flushed until `lock_cap` has passed since it was taken; its release flushes at once. A rescan's
changes (its `diff`, with its cause as path) replace what is pending, and its batch is flushed when due even if empty,
marked with the cause.

Events are applied in the order of (ts, event_id, path, kind), whatever batches they come in: the stream holds them until
the watermark has passed them. An event that comes when the watermark has reached its time is late; it changes nothing and
leaves by the side output. The bounded form gives the same batches from a table.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

QUIET_MS, MAX_WAIT_MS, LOCK_CAP_MS = 200, 2_000, 30_000
BATCH = "root string, flushed_ms long, cause string, path string, kind string"
#: A stream's rows: those of batches, and late events with their time and id, which batches don't have.
OUTPUT = f"{BATCH}, late_ms long, event_id long"
DIFF = "array<struct<path:string, kind:string>>"
#: Events of a part of a bounded table, as far as quiet gaps allow.
PART_EVENTS = 4096
#: Held events to an entry of the state, paths that a root's changes keep in memory, and rows to a frame of output.
RUN_EVENTS, NEAR_PATHS, OUT_ROWS = 256, 10_000, 10_000
ORDER = ["ts_ms", "event_id", "path", "kind"]


def merge(previous: str | None, following: str) -> str | None:
    """Two changes of a path as one; None when they cancel."""
    if previous is None:
        return following
    if previous == "created":
        return None if following == "deleted" else "created"
    return "changed" if previous == "deleted" and following == "created" else following


class Pending:
    """A root's pending changes, a mapping of paths to kinds, and its clocks in milliseconds."""

    def __init__(self, changes, clocks: tuple | None, quiet: int, max_wait: int, lock_cap: int):
        self.changes, (self.first, self.last, self.lock, self.cause) = changes, clocks or (None, None, None, None)
        self.quiet, self.max_wait, self.lock_cap = quiet, max_wait, lock_cap

    def clocks(self) -> tuple:
        return self.first, self.last, self.lock, self.cause

    def has_batch(self) -> bool:
        return len(self.changes) > 0 or self.cause is not None

    def due(self) -> int | None:
        """When the next flush is, or None with nothing pending."""
        if not self.has_batch():
            return None
        at = min(self.last + self.quiet, self.first + self.max_wait)
        return at if self.lock is None else max(at, self.lock + self.lock_cap)

    def record(self, ts: int, path: str, kind: str) -> None:
        merged = merge(self.changes.get(path), kind)
        if merged is None:
            self.changes.pop(path, None)
        else:
            self.changes[path] = merged
        self.touch(ts)

    def touch(self, ts: int) -> None:
        if not self.has_batch():  # all cancelled: the next change starts anew
            self.first = self.last = None
            return
        self.first = ts if self.first is None else self.first
        self.last = ts

    def flush(self, at: int) -> list[tuple]:
        out = [(at, self.cause, p, k) for p, k in sorted(self.changes.items())] or [(at, self.cause, None, None)]
        self.changes.clear()
        self.first = self.last = self.cause = None
        return out

    def advance(self, now: int) -> list[tuple]:
        """What falls due up to `now`."""
        at = self.due()
        return self.flush(at) if at is not None and at <= now else []

    def take(self, ts: int, path: str, kind: str, diff: list | None = None) -> list[tuple]:
        """One event, after what fell due before it."""
        out = self.advance(ts)
        if kind == "lock":
            self.lock = ts if self.lock is None else self.lock
        elif kind == "unlock" and self.lock is not None:
            self.lock = None
            out += self.flush(ts) if self.has_batch() else []
        elif kind == "rescan":
            self.changes.clear()
            for d in [] if diff is None else diff:
                self.changes[d["path"]] = d["kind"]
            self.cause = path or "rescan"
            self.touch(ts)
        elif kind != "unlock":
            self.record(ts, path, kind)
        return out


class StoredChanges:
    """Pending changes kept in a map state, of which only the paths that events name are read. Changes stay in memory until
    store(), or until NEAR_PATHS paths are held; what is flushed before is never written."""

    def __init__(self, state, size: int):
        self.state, self.size, self.stored, self.near, self.dirty = state, size, size > 0, {}, set()

    def get(self, path: str) -> str | None:
        if path not in self.near:
            if len(self.near) >= NEAR_PATHS:
                self.store()
                self.near = {}
            found = self.state.getValue((path,)) if self.stored and self.state.containsKey((path,)) else None
            self.near[path] = found[0] if found else None
        return self.near[path]

    def __setitem__(self, path: str, kind: str) -> None:
        before = self.get(path)
        self.size += before is None
        if kind != before:
            self.near[path] = kind
            self.dirty.add(path)

    def pop(self, path: str, _) -> None:
        if self.get(path) is not None:
            self.near[path] = None
            self.dirty.add(path)
            self.size -= 1

    def items(self) -> list[tuple]:
        kept = {k[0]: v[0] for k, v in self.state.iterator()} if self.stored else {}
        return [x for x in (kept | {p: self.near[p] for p in self.dirty}).items() if x[1] is not None] if self.size else []

    def clear(self) -> None:
        if self.stored:
            self.state.clear()
        self.size, self.stored, self.near, self.dirty = 0, False, {}, set()

    def store(self) -> None:
        """Writes what has changed since the last time."""
        for path in self.dirty:
            if self.near[path] is not None:
                self.state.updateValue((path,), (self.near[path],))
            elif self.stored:
                self.state.removeKey((path,))
        self.stored, self.dirty = self.size > 0, set()

    def __len__(self) -> int:
        return self.size


class Coalescer(StatefulProcessor):
    """A root's state: events held until the watermark passes them, pending changes, clocks, and a timer for whichever
    of the earliest held event and the next flush comes first. Held events lie in sorted runs, one to an input batch, cut
    in parts of RUN_EVENTS; due parts of all runs are merged, and one part of each run is in memory at a time."""

    def __init__(self, quiet: int, max_wait: int, lock_cap: int):
        self.limits = quiet, max_wait, lock_cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "run long, part long, first_ms long", "events string")
        self.runs = handle.getValueState("runs", "n long")
        self.pending = handle.getMapState("pending", "path string", "kind string")
        self.clocks = handle.getValueState("clocks", "first long, last long, lock long, cause string, size int")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        watermark, earliest = timerValues.getCurrentWatermarkInMs(), None
        began = run = self.runs.get()[0] if self.runs.exists() else 0
        for part in rows:
            late = part["ts_ms"] <= watermark
            if late.any():
                yield output([(key[0], None, None, path, kind, ts, event) for ts, event, path, kind in zip(*(part[late][c].tolist() for c in ORDER), strict=True)])
            events = part[~late].sort_values(ORDER, kind="stable")
            if len(events):
                diffs = [None if d is None else [(x["path"], x["kind"]) for x in d] for d in events["diff"]] if "diff" in events else [None] * len(events)
                events = list(zip(*(events[c].tolist() for c in ORDER), diffs, strict=True))
                for n, at in enumerate(range(0, len(events), RUN_EVENTS)):
                    self.held.updateValue((run, n, events[at][0]), (json.dumps(events[at : at + RUN_EVENTS]),))
                earliest, run = events[0][0] if earliest is None else min(earliest, events[0][0]), run + 1
        if earliest is not None:
            self.handle.registerTimer(earliest)
        if run > began:
            self.runs.update((run,))

    def take_part(self, key: tuple, now: int, waiting: list[int]) -> list:
        """A part's events up to `now`, which leave the state; those after it are held on, from the time put in `waiting`."""
        events = json.loads(self.held.getValue(key)[0])
        self.held.removeKey(key)
        n = next((n for n, e in enumerate(events) if e[0] > now), len(events))
        if n < len(events):
            self.held.updateValue((*key[:2], events[n][0]), (json.dumps(events[n:]),))
            waiting.append(events[n][0])
        return events[:n]

    def due_events(self, now: int, waiting: list[int]) -> Iterator[list]:
        """Held events up to `now` in order. Of equal ones the last that came counts."""
        runs: dict[int, list[tuple]] = {}
        for run, part, first in sorted(tuple(k) for k in self.held.keys()) if self.held.exists() else []:
            if first > now:
                waiting.append(first)
            else:
                runs.setdefault(run, []).append((run, part, first))
        streams = [(e for key in keys for e in self.take_part(key, now, waiting)) for keys in map(tuple, runs.values())]
        before = None
        for event in heapq.merge(*streams, key=lambda e: e[:4]):
            if before is not None and before[:4] != event[:4]:
                yield before
            before = event
        if before is not None:
            yield before

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        now, out, waiting = timerValues.getCurrentWatermarkInMs(), [], []
        *clocks, size = self.clocks.get() if self.clocks.exists() else (None, None, None, None, 0)
        pending = Pending(StoredChanges(self.pending, size), tuple(clocks), *self.limits)
        for ts, _, path, kind, diff in self.due_events(now, waiting):
            out += pending.take(ts, path, kind, None if diff is None else [{"path": d[0], "kind": d[1]} for d in diff])
            if len(out) >= OUT_ROWS:
                yield output([(key[0], *row, None, None) for row in out])
                out = []
        out += pending.advance(now)
        pending.changes.store()
        self.clocks.update((*pending.clocks(), len(pending.changes)))
        waiting += [x for x in [pending.due()] if x is not None]
        if waiting:
            self.handle.registerTimer(min(waiting))
        yield output([(key[0], *row, None, None) for row in out])

    def close(self) -> None:
        pass


def output(rows: list[tuple]):
    import pandas as pd

    frame = pd.DataFrame(rows, columns=["root", "flushed_ms", "cause", "path", "kind", "late_ms", "event_id"], dtype=object)
    return frame.astype({"flushed_ms": "Int64", "late_ms": "Int64", "event_id": "Int64"})


def in_ms(events: DataFrame) -> DataFrame:
    diff = [F.col("diff").cast(DIFF).alias("diff")] if "diff" in events.columns else []
    return events.select("root", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_id").cast("long").alias("event_id"), F.coalesce("path", F.lit("")).alias("path"), "kind", *diff)


def coalesce_stream(events: DataFrame, quiet_ms: int = QUIET_MS, max_wait_ms: int = MAX_WAIT_MS, lock_cap_ms: int = LOCK_CAP_MS, watermark: str = "1 second") -> DataFrame:
    """OUTPUT rows of a stream of events with a timestamp ts: batches, and late events beside them. Timers run in event
    time, so that a replay gives the same batches. Its state is kept in RocksDB."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = in_ms(events.withWatermark("ts", watermark))  # without ts, late events reach the processor
    return rows.groupBy("root").transformWithStateInPandas(Coalescer(quiet_ms, max_wait_ms, lock_cap_ms), OUTPUT, "append", "eventTime")


def batches(out: DataFrame) -> DataFrame:
    return out.where("late_ms IS NULL").select("root", "flushed_ms", "cause", "path", "kind")


def late_events(out: DataFrame) -> DataFrame:
    """The side output: root, late_ms, event_id, path, kind of late events."""
    return out.where("late_ms IS NOT NULL").select("root", "late_ms", "event_id", "path", "kind")


def write_coalesced(out: DataFrame, folder: str, checkpoint: str):
    """A writer of both outputs of coalesce_stream(): batches under `folder`/batches, late events under `folder`/late, each
    as one numbered part per micro-batch, which a replay of the micro-batch writes anew."""

    def write(df: DataFrame, n: int) -> None:
        df.persist()
        for name, rows in (("batches", batches(df)), ("late", late_events(df))):
            rows.write.mode("overwrite").parquet(f"{folder}/{name}/part={n}")
        df.unpersist()

    return out.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")


def coalesce_batch(events: DataFrame, quiet_ms: int = QUIET_MS, max_wait_ms: int = MAX_WAIT_MS, lock_cap_ms: int = LOCK_CAP_MS) -> DataFrame:
    """The same batches from a bounded table, with what is pending at its end. A root's events are cut where all that came
    before has been flushed for certain (a quiet gap, at the end of which no lock holds it back), some thousands of events
    to a part; each part is replayed on its own from the lock that is held then."""
    rows = in_ms(events)
    if "diff" not in rows.columns:
        rows = rows.withColumn("diff", F.lit(None).cast(DIFF))
    before = Window.partitionBy("root").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    since_unlock = Window.partitionBy("root", "unlocks").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("unlocks", F.count(F.when(F.col("kind") == "unlock", 1)).over(before)).withColumn("lock_ms", F.min(F.when(F.col("kind") == "lock", F.col("ts_ms"))).over(since_unlock))
    last = F.lag("ts_ms").over(Window.partitionBy("root").orderBy(*ORDER))
    starts = (F.col("ts_ms") >= last + quiet_ms) & (F.col("lock_ms").isNull() | (F.col("ts_ms") >= F.col("lock_ms") + lock_cap_ms))
    in_order = Window.partitionBy("root").orderBy(*ORDER)
    rows = rows.withColumn("start", F.when(F.coalesce(starts, F.lit(True)), F.row_number().over(in_order)))
    rows = rows.withColumn("part", F.expr(f"max(start) OVER (PARTITION BY root ORDER BY {', '.join(ORDER)}) DIV {PART_EVENTS}")).drop("unlocks", "start")

    def run(frames):
        """The parts of a task one after the other; only the pending changes of one are in memory."""
        of, pending, out = None, None, []

        def ended() -> list[tuple]:
            due = None if pending is None else pending.due()
            return [] if due is None else [(of[0], *row) for row in pending.flush(due)]

        for pdf in frames:
            columns = (pdf[c].tolist() for c in ("root", "part", "ts_ms", "path", "kind"))
            for root, part, ts, path, kind, lock, diff in zip(*columns, pdf["lock_ms"], pdf["diff"], strict=True):
                if (root, part) != of:
                    out += ended()
                    of, held = (root, part), None if lock is None or lock != lock else int(lock)
                    pending = Pending({}, (None, None, held, None), quiet_ms, max_wait_ms, lock_cap_ms)
                out += [(root, *row) for row in pending.take(ts, path, kind, diff)]
                if len(out) >= OUT_ROWS:
                    yield batch_rows(out)
                    out = []
        yield batch_rows(out + ended())

    return rows.repartition("root", "part").sortWithinPartitions("root", "part", *ORDER).mapInPandas(run, BATCH)


def batch_rows(rows: list[tuple]):
    import pandas as pd

    return pd.DataFrame(rows, columns=["root", "flushed_ms", "cause", "path", "kind"], dtype=object).astype({"flushed_ms": "Int64"})


def filter_stream(events: DataFrame, excluded_prefixes: list[str], excluded_components: list[str]) -> DataFrame:
    """Drops excluded paths and turns changes of the lock file into lock and unlock events."""
    from graphloom.operators.changes import classify_path

    rows = events.withColumn("class", classify_path(F.col("path"), excluded_prefixes, excluded_components))
    kind = F.when(F.col("class") == "index-lock", F.when(F.col("kind") == "deleted", "unlock").otherwise("lock")).otherwise(F.col("kind"))
    return rows.where("class <> 'excluded'").withColumn("kind", kind).drop("class")


def versions(spark, folder: str) -> list[int]:
    """The numbers of the complete versions under `folder`, rising."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS")))


def read_baseline(spark, folder: str, n: int | None = None) -> DataFrame:
    """The newest baseline, or that after micro-batch `n`."""
    return spark.read.parquet(f"{folder}/{versions(spark, folder)[-1] if n is None else n}")


def write_baselines(batches: DataFrame, folder: str, observed: DataFrame, checkpoint: str, keep: int = 2, start: DataFrame | None = None):
    """A writer that applies each micro-batch of flushed changes to the baseline snapshot, `start` or an empty one at first:
    version n is made of the newest version below n, so a replay of micro-batch n after a failure writes the same version again. The newest `keep`
    versions stay, two at least, for a replay needs the one before it."""
    from graphloom.operators.changes import advance_baseline

    def apply(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        before = [v for v in versions(spark, folder) if v < n]
        baseline = spark.read.parquet(f"{folder}/{before[-1]}") if before else observed.limit(0) if start is None else start
        advance_baseline(baseline, last_changes(df), observed).write.mode("overwrite").parquet(f"{folder}/{n}")
        root = spark._jvm.org.apache.hadoop.fs.Path(folder)
        for old in [*before, n][: -max(keep, 2)]:
            root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{old}"), True)

    return batches.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("append")


def last_changes(flushed: DataFrame) -> DataFrame:
    """path, kind: each path's latest change among flushed batches (root, flushed_ms, path, kind)."""
    return flushed.where("path IS NOT NULL").groupBy("path").agg(F.max_by("kind", F.struct("flushed_ms", "kind")).alias("kind"))
