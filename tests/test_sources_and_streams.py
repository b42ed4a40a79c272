"""Sources, snapshots and streams."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import frames
from graphloom.plans import catalog, change_streams, inputs, round_trips
from graphloom.sources import readers, snapshots
from graphloom.streaming import coalesce, guards


def test_flatten_index(spark):
    docs = spark.createDataFrame([("a\\b", 0, [("f", [1, 2, 3], None, 1), ("local 1", [1, 2, 3, 4], None, 0)], [("f", "Function", [])])], readers.DOCUMENT)
    occ, info = readers.flatten_index(docs)
    assert [(r["path"], r["pos"], r["symbol"]) for r in occ.orderBy("pos").collect()] == [("a/b", 0, "f"), ("a/b", 1, "local 1")] and info.count() == 1


def test_strict_json_lines(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"a": 1}\n\n  \n{"a": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{"a": oops}\n')
    assert readers.read_jsonl_strict(spark, str(tmp_path / "good.jsonl"), "a int").count() == 2
    with pytest.raises(readers.BadInput, match="line 3"):
        readers.read_jsonl_strict(spark, str(tmp_path / "bad.jsonl"), "a int")


def test_call_graph_maps(spark):
    g = {"files": ["x.ts", "y.ts"], "functions": {"10": "0:1:1:9:1", "2": "0:2:3:4:5", "11": "1:1:1:9:9"}, "calls": {"5": "0:3:1:3:9"}, "call2fun": [[5, 2]]}
    frame = lambda x: spark.createDataFrame([(json.dumps(x),)], "value string")
    got = readers.read_call_graph_maps(frame(g))
    assert {r["id"]: (r["path"], r["is_module"], r["start_line"]) for r in got["functions"].collect()} == {10: ("x.ts", True, 0), 11: ("y.ts", True, 0), 2: ("x.ts", False, 1)}
    with pytest.raises(readers.BadInput):
        readers.read_call_graph_maps(frame(g | {"call2fun": [[5, 99]]}))


def test_files_and_logs(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.rs").write_bytes(b"abc")
    got = readers.file_table(spark, str(tmp_path), {".rs": "rust"}).collect()
    assert [tuple(r) for r in got] == [("src/a.rs", "rust", "sha256:ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad", 3)]
    (tmp_path / "log.jsonl").write_text('{"from":"client","kind":"request","method":"m","id":1,"ts_ms":5,"msg":{"x":1}}\n{"event":"start","ts_ms":1}\n{"from":"server","id":"1"}\n')
    messages, events = readers.read_session_log(spark, str(tmp_path / "log.jsonl"))
    assert sorted((r["sender"], r["id"], r["method"], r["ts_ms"]) for r in messages.collect()) == [("client", "1", "m", 5), ("server", '"1"', "", 0)] and events.count() == 1


def test_baselines_round_trip(spark):
    rows = [("go", "b", 2), ("go", "a", 1), ("rust", "c", 0)]
    text = readers.edge_baseline_text(spark.createDataFrame(rows, "provider string, path string, edge_count long"))
    value = text.first()[0]
    assert json.loads(value) == {"go": {"a": 1, "b": 2}, "rust": {"c": 0}} and value.endswith("}\n") and value.index('"a"') < value.index('"b"')
    assert sorted(map(tuple, readers.read_edge_baseline(text).collect())) == sorted(rows)


def test_snapshots(spark, tmp_path):
    root = f"file://{tmp_path}/gens"
    table = {"file": spark.createDataFrame([("a", "rust", "h", 1)], snapshots.SCHEMAS["file"])}
    with pytest.raises(snapshots.Incomparable):
        snapshots.read_generation(spark, root)
    assert snapshots.publish_generation(spark, table, root) == 1
    table["file"].write.parquet(f"{root}/gen=2/file")  # never completed
    assert snapshots.publish_generation(spark, {"file": table["file"].union(table["file"])}, root) == 3
    assert snapshots.read_generation(spark, root)["file"].count() == 2 and snapshots.read_generation(spark, root, 1)["file"].count() == 1
    with pytest.raises(snapshots.Incomparable):
        snapshots.read_generation(spark, root, 2)
    assert snapshots.publish_generation(spark, table, root, version=2) == 4
    with pytest.raises(snapshots.Incomparable, match="version 2"):
        snapshots.read_generation(spark, root)
    folder = f"{tmp_path}/targets"
    for run in (1, 2):
        snapshots.write_call_targets(spark.createDataFrame([(run, "t", "scip", run)], "site_id long, target string, method string, run_id int"), folder)
    assert spark.read.parquet(folder).count() == 2


def replay(events, **clocks):
    """(root's) batches of a list of (ms, path, kind), with a last look far ahead."""
    p = coalesce.Pending({}, None, clocks.get("quiet", 200), clocks.get("max_wait", 2000), clocks.get("cap", 30_000))
    out = []
    for ts, path, kind, *diff in events:
        out += p.take(ts, path, kind, diff[0] if diff else None)
    return out + p.advance(10**9)


def test_coalescing_clocks():
    assert replay([(0, "a", "created"), (100, "a", "changed")]) == [(300, None, "a", "created")]
    assert replay([(t, "a", "changed") for t in range(0, 2100, 100)]) == [(2000, None, "a", "changed"), (2200, None, "a", "changed")]
    assert replay([(0, "a", "created"), (100, "a", "deleted"), (5000, "b", "changed")]) == [(5200, None, "b", "changed")]
    assert replay([(0, "", "lock"), (10, "a", "changed"), (5000, "", "unlock")]) == [(5000, None, "a", "changed")]
    assert replay([(0, "", "lock"), (10, "a", "changed")]) == [(30_000, None, "a", "changed")]
    assert replay([(0, "a", "changed"), (50, "overflow", "rescan", [])]) == [(250, "overflow", None, None)]
    assert replay([(0, "a", "changed"), (50, "overflow", "rescan", [{"path": "b", "kind": "created"}])]) == [(250, "overflow", "b", "created")]
    assert replay([(0, "", "lock"), (10, "o", "rescan", []), (500, "", "unlock")]) == [(500, "o", None, None)]


#: Merges of two changes of a path, in fixed order: first, second, what is flushed.
MERGES = [("created", "deleted", None), ("created", "changed", "created"), ("created", "created", "created"), ("deleted", "created", "changed"), ("deleted", "changed", "changed"), ("deleted", "deleted", "deleted"), ("changed", "deleted", "deleted"), ("changed", "changed", "changed"), ("changed", "created", "created")]
WATCHED = "root string, t long, event_id long, path string, kind string, diff array<struct<path:string, kind:string>>"
BASE = 1_700_000_000_000


def watched(spark, rows):
    """Events of (root, ms, path, kind[, diff]), numbered in order."""
    made = [(r, t, i, p, k, diff[0] if diff else None) for i, (r, t, p, k, *diff) in enumerate(rows)]
    return spark.createDataFrame(made, WATCHED).select("root", F.timestamp_millis(F.col("t") + BASE).alias("ts"), "event_id", "path", "kind", "diff")


def coalesced(spark, folder, parts, **clocks):
    """(batches, late events) of a stream that gets `parts` one by one, and then an event an hour later."""
    for k, part in enumerate([*parts, watched(spark, [("end", 3_600_000 * 24, "", "unlock")])]):
        part.coalesce(1).write.parquet(f"{folder}/in/{k}")
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    assert coalesce.write_coalesced(coalesce.coalesce_stream(stream, **clocks), f"{folder}/out", f"{folder}/state").trigger(availableNow=True).start().awaitTermination(300)
    return [sorted((tuple(r) for r in spark.read.parquet(f"{folder}/out/{x}").drop("part").collect()), key=repr) for x in ("batches", "late")]


def test_streamed_batches_equal_replayed_ones(spark, tmp_path):
    """Each case of merging and timing in a root of its own: locks, caps, rescans, cancelled changes, longest waits."""
    diff = [("b", "created"), ("c", "deleted")]
    cases = [[(0, "x", a), (10, "x", b)] for a, b, _ in MERGES]
    cases += [
        [(0, "n", "created"), (10, "n", "deleted"), (20, "n", "created")],
        [(0, "a", "changed"), (5, "b", "deleted"), (6, "c", "created")],
        [(t, f"p{t}", "changed") for t in range(0, 700, 90)],
        [(0, "", "lock"), (10, "a", "changed"), (20, "b", "deleted"), (5001, "", "unlock"), (5002, "c", "changed")],
        [(0, "", "lock"), (10, "a", "changed"), (9000, "b", "changed")],
        [(0, "", "lock"), (10, "", "unlock"), (20, "", "unlock"), (30, "a", "changed")],
        [(0, "a", "changed"), (10, "b", "created"), (20, "overflow", "rescan", diff), (400, "b", "deleted")],
        [(0, "overflow", "rescan", diff), (10, "b", "deleted"), (20, "d", "changed")],
        [(0, "a", "changed"), (20, "moved", "rescan", None)],
        [(0, "", "lock"), (10, "moved", "rescan", []), (500, "", "unlock")],
    ]
    rows = [(f"r{n:02}", *e) for n, case in enumerate(cases) for e in case]
    clocks = {"quiet_ms": 100, "max_wait_ms": 300, "lock_cap_ms": 2000}
    events = watched(spark, rows)
    want = sorted(((f"r{n:02}", at + BASE, cause, p, k) for n, case in enumerate(cases) for at, cause, p, k in replay([(t, p, k, *([[{"path": x, "kind": y} for x, y in d[0] or []]] if d else [])) for t, p, k, *d in case], quiet=100, max_wait=300, cap=2000)), key=repr)
    assert [k for _, _, k in MERGES if k] == [r[4] for n in range(9) for r in want if r[0] == f"r{n:02}"]
    got, late = coalesced(spark, tmp_path, [events], **clocks)
    assert got == want and late == []
    assert sorted(map(tuple, coalesce.coalesce_batch(events, **clocks).collect()), key=repr) == want


def test_rows_in_batches_and_late_rows_are_all_rows(spark, tmp_path):
    """Disorder within the watermark changes nothing; what is older leaves by the side output and nowhere else."""
    rows = [("r", t * 400, f"p{t % 7}", "changed" if t % 3 else "created") for t in range(40)]
    events = watched(spark, rows)
    parts = [events.where("event_id IN (1, 0, 3, 8)"), events.where("event_id IN (2, 7, 9, 5)"), events.where("event_id > 9 AND event_id < 30 OR event_id = 6"), events.where("event_id = 4"), events.where("event_id >= 30 OR event_id = 12")]
    got, late = coalesced(spark, tmp_path, parts, quiet_ms=100, max_wait_ms=1000)
    gone = {r[2] for r in late}
    assert gone == {2, 4, 5, 12} or gone == {2, 4, 5, 6, 12}
    kept = events.where(~F.col("event_id").isin(*(gone - {12})))  # 12 came twice, in time and late
    assert got == sorted(map(tuple, coalesce.coalesce_batch(kept, 100, 1000).collect()), key=repr)
    assert len(got) + len(late) == 41  # each event is a batch of its own here


def test_batch_parts_are_independent(spark, monkeypatch):
    import random

    r, rows, t = random.Random(2), [], 0
    for _ in range(600):
        t += r.choice([1, 5, 20, 90, 250, 900])
        kind = r.choice(["created", "changed", "deleted"] * 6 + ["lock", "unlock", "unlock"])
        rows.append(("r", t, f"p{r.randrange(4)}", kind))
    events = watched(spark, rows)
    want = sorted(((("r"), at + BASE, c, p, k) for at, c, p, k in replay([x[1:] for x in rows], quiet=100, max_wait=300, cap=1500)), key=repr)
    for size in (1, 50, 4096):
        monkeypatch.setattr(coalesce, "PART_EVENTS", size)
        assert sorted(map(tuple, coalesce.coalesce_batch(events, 100, 300, 1500).collect()), key=repr) == want


class Kept:
    """A value or map state that counts its calls."""

    calls = 0

    def __init__(self, *_):
        self.data = {}

    def __getattr__(self, name):
        def call(*args):
            Kept.calls += 1
            if name in ("updateValue", "update"):
                self.data[tuple(args[0]) if len(args) > 1 else None] = args[-1]
                return None
            if name == "removeKey":
                return self.data.pop(tuple(args[0]), None)
            return {"exists": lambda: bool(self.data), "containsKey": lambda k: tuple(k) in self.data, "getValue": lambda k: self.data.get(tuple(k)), "get": lambda: self.data[None], "keys": lambda: list(self.data), "iterator": lambda: list(self.data.items()), "clear": self.data.clear}[name](*args)

        return call


class KeptHandle:
    getMapState = getValueState = lambda self, *_: Kept()
    registerTimer = lambda self, at: None


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_a_held_event_costs_no_call_of_the_state(monkeypatch):
    """20,000 events of a root in disorder, some held twice, and a watermark that passes them in two steps."""
    import random

    import pandas as pd

    monkeypatch.setattr(coalesce, "NEAR_PATHS", 50)
    r = random.Random(1)
    rows = [(n * 20, n, f"p{r.randrange(90)}" if n % 7 else "end", r.choice(["created", "changed", "deleted"])) for n in range(1, 20_001)]
    mixed = r.sample(rows, len(rows)) + rows[:100]
    one = coalesce.Coalescer(100, 1000, 5000)
    one.init(KeptHandle())
    Kept.calls = 0
    frames = [pd.DataFrame(mixed[at : at + 4000], columns=coalesce.ORDER) for at in range(0, len(mixed), 4000)]
    out = [f for f in one.handleInputRows(("r",), iter(frames), Clock(0))]
    for now in (rows[9_000][0], rows[-1][0] + 5000):
        out += one.handleExpiredTimer(("r",), Clock(now), None)
    got = [tuple(x) for f in out for x in f[["flushed_ms", "cause", "path", "kind"]].itertuples(index=False)]
    want = coalesce.Pending({}, None, 100, 1000, 5000)
    expected = [x for ts, _, path, kind in rows for x in want.take(ts, path, kind)]
    assert got == expected + want.flush(want.due())
    assert Kept.calls < len(rows)  # 71,990 when each held event was an entry


def test_a_root_without_gaps_is_read_in_batches(spark):
    """A root's part that no quiet gap cuts is streamed, not gathered in one group."""
    rows = [("r", t * 50, f"p{t % 40}", "changed") for t in range(2_000)] + [("s", 0, "a", "created")]
    got = coalesce.coalesce_batch(watched(spark, rows), 100, 1000)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        found = sorted(map(tuple, got.collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [("r", at + BASE, c, p, k) for at, c, p, k in replay([x[1:] for x in rows[:-1]], quiet=100, max_wait=1000)]
    assert found == sorted([*want, ("s", 100 + BASE, None, "a", "created")], key=repr)


def test_baselines_survive_a_restart(spark, tmp_path):
    """A stream that fails after a version is written, and is started again, ends at the baseline of one replay."""
    flushed = [("r", 10, None, "a", "created"), ("r", 10, None, "b", "created")], [("r", 20, None, "a", "deleted"), ("r", 20, None, "c", "changed")], [("r", 30, None, "a", "created"), ("r", 30, "scan", None, None)], [("r", 40, None, "b", "deleted")]
    observed = spark.createDataFrame([("a", False, 1, 1), ("b", False, 2, 2), ("c", False, 3, 3)], "path string, is_dir boolean, len long, modified long")
    for k, rows in enumerate(flushed):
        spark.createDataFrame(rows, coalesce.BATCH).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = lambda: spark.readStream.schema(coalesce.BATCH).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    real, calls = coalesce.last_changes, []

    def failing(df):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("killed")
        return real(df)

    folder, start = f"{tmp_path}/baselines", lambda: coalesce.write_baselines(stream(), f"{tmp_path}/baselines", observed, f"{tmp_path}/state").trigger(availableNow=True).start()
    coalesce.last_changes = failing
    try:
        with pytest.raises(Exception, match="killed"):
            start().awaitTermination(120)
    finally:
        coalesce.last_changes = real
    assert coalesce.versions(spark, folder) == [0, 1]
    start().awaitTermination(120)
    assert coalesce.versions(spark, folder) == [2, 3]  # older versions are deleted
    assert sorted(r["path"] for r in coalesce.read_baseline(spark, folder).collect()) == ["a", "c"]
    again = coalesce.write_baselines(stream(), f"{tmp_path}/again", observed, f"{tmp_path}/state2").trigger(availableNow=True).start()
    again.awaitTermination(120)
    assert coalesce.read_baseline(spark, f"{tmp_path}/again").exceptAll(coalesce.read_baseline(spark, folder)).isEmpty()


def test_guard():
    state = None
    for ts in (0, 0, 0):
        state = guards.guard(state, ts, 1000, 3)
    assert state[0] == 3 and state[2]
    state = guards.guard(state, 5000, 1000, 3)
    assert not state[2] and state[0] == pytest.approx(3 / 32 + 1)


def test_filter_stream(spark):
    df = spark.createDataFrame([(".git/index.lock", "created"), (".git/index.lock", "deleted"), ("build/x", "created"), ("a", "changed")], "path string, kind string")
    assert sorted(map(tuple, coalesce.filter_stream(df, ["build"], []).select("path", "kind").collect())) == [(".git/index.lock", "lock"), (".git/index.lock", "unlock"), ("a", "changed")]


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_baseline_batches_are_written_by_many_tasks(spark, monkeypatch):
    """Neither the difference of snapshots nor a batch of it passes one task, and two micro-batches take all files."""
    at, made = "/root/testdata/sf0.01", []
    monkeypatch.setattr(frames, "TASK_ROWS", 100, raising=False)
    monkeypatch.setattr(change_streams, "folder", lambda r, name: (made.append(folder(r, name)), made[-1])[1])
    r = lambda name, given=None: inputs.relation(spark, at, name, given)
    folder = round_trips.folder
    got = change_streams.baseline_stream(r)
    assert all(len(spark.read.parquet(f"{made[0]}/in/{n}").inputFiles()) > 1 for n in range(2))
    assert coalesce.versions(spark, f"{made[0]}/out") == [0, 1]
    a, b = r("snapshot_old").toDF("path", "d", "l", "m"), r("snapshot_new")
    stays = F.coalesce(F.col("d") & F.col("is_dir"), F.lit(False))
    want = b.join(a, "path", "left").select("path", *[F.when(stays, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("d", "is_dir"), ("l", "len"), ("m", "modified"))])
    assert got.count() == want.count() and got.exceptAll(want.select(got.columns)).isEmpty()
