"""Ordered folds, the guard, name matches in tiles, notifications and tag files, against plain replays."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import changes, facets, folds
from graphloom.operators import graph_views as gv
from graphloom.streaming import coalesce, guards


def test_folds_equal_a_replay(spark, monkeypatch):
    r = random.Random(1)
    monkeypatch.setattr(folds, "LEVELS", (3, 6, 9))
    rows = [("r", f"p{r.randrange(6)}", r.randrange(4000), i, r.choice(["created", "changed", "deleted"])) for i in range(900)]
    state = {}
    for root, path, t, i, kind in sorted(rows, key=lambda x: (x[2], x[3])):
        merged = coalesce.merge(state.get((root, path)), kind)
        state.pop((root, path), None)
        if merged:
            state[root, path] = merged
    df = spark.createDataFrame(rows, "root string, path string, t long, event_id long, kind string").withColumn("ts", F.timestamp_millis("t")).repartition(5)
    got = changes.merge_events(df)
    assert {(x["root"], x["path"]): x["kind"] for x in got.collect()} == state
    assert changes.merge_events(df.limit(0)).count() == 0


@pytest.mark.parametrize("half_life", [1.0, 50.0])
def test_guard_trips_and_clears(spark, half_life):
    r, rows, t = random.Random(2), [], 0.0
    for i in range(800):
        t += r.choice([0.0, 0.1, 0.5, 3.0, 100.0, 700.0, 9000.0]) * half_life / 10
        rows.append((r.choice("ab"), t, i))
    want, last, state = {}, {}, {}
    for actor, ts, i in rows:
        state[actor] = guards.guard(state.get(actor), ts, half_life, 4.0)
        want[i] = last[actor] = (state[actor][0], state[actor][2])
    df = spark.createDataFrame(rows, "actor string, ts double, op_id long").repartition(4)
    got = {x["op_id"]: (x["c"], x["tripped"]) for x in gv.guarded(df, half_life, 4.0).collect()}
    assert got.keys() == want.keys() and all(got[i][0] == pytest.approx(want[i][0], rel=1e-9) and got[i][1] == want[i][1] for i in want)
    assert {True, False} == {x[1] for x in want.values()}
    assert {x["actor"]: (pytest.approx(x["c"], rel=1e-9), x["tripped"]) for x in gv.decay_guard(df, half_life, 4.0).collect()} == last


def test_a_common_name_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(gv, "NAME_TILE", 8)
    symbol = spark.createDataFrame([(f"s{i}", "a.b.get" if i < 100 else f"a.n{i}") for i in range(120)] + [("s0", "a.b.get")], "id string, name string")
    named = spark.createDataFrame([(i, "get" if i < 90 else f"n{i + 20}") for i in range(105)] + [(0, "get")], "site_id long, name string")
    got = gv.name_matches(named, symbol).collect()
    want = {(i, f"s{j}", 100) for i in range(90) for j in range(100)} | {(i, f"s{i + 20}", 1) for i in range(90, 100)}
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert {(x["site_id"], x["candidates"]) for x in gv.name_candidates(named, symbol).collect()} == {(i, n) for i, _, n in want}


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_fifty_consumers_are_told_in_one_scan(spark, tmp_path):
    rows = [(f"i{i}", k, str(v)) for i in range(60) for k, v in (("size", i), ("kind", "x" if i % 3 else "y"))]
    spark.createDataFrame(rows, "item string, key string, value string").write.parquet(f"{tmp_path}/t")
    tags = spark.read.parquet(f"{tmp_path}/t")
    consumers = [(f"c{n}", facets.facet_lt("size", n) & ~facets.facet_eq("kind", "y")) for n in range(50)]
    got = facets.notify(tags, consumers)
    assert scans(got) == 1
    assert {tuple(x) for x in got.collect()} == {(f"c{n}", f"i{i}") for n in range(50) for i in range(n) if i % 3}
    assert facets.notify(tags, []).count() == 0


def test_tag_files(spark, monkeypatch):
    monkeypatch.setattr(gv, "LINES", 4)
    lines = [
        (1, "file:src/b.rs", ["owner=core"]), (9, "file:src/a.rs", ["x"]), (10, "file:src/c.rs", []), (30, "file:src/c.rs", ["z", "a", "a"]), (31, "sym:a.B", ["x"]), (33, "dir:src", ["x"]), (40, "file:./a", ["x"]), (50, "file:src//b.rs", ["x"]),
        (51, "file:/a", ["x"]), (52, "file:../a", ["x"]), (53, "file:src/nope.rs", ["a<b", "area=a/b", "kind=function"]), (54, "file:z", None),
    ]
    items = spark.createDataFrame([(x,) for x in ("file:src/a.rs", "file:src/b.rs", "file:src/c.rs", "file:z")], "item string")
    got = {}
    for n, v in gv.check_tags(spark.createDataFrame(lines, "line_no long, item string, tags array<string>").repartition(3), items).collect():
        got.setdefault(n, set()).add(v)
    paths = {"bad-path", "orphan"}
    assert got == {
        9: {"unsorted"}, 10: {"no-tags"}, 30: {"duplicate-item of line 10", "duplicate-tag a", "tags-unsorted"}, 31: {"symbol-item", "orphan"}, 33: {"bad-kind", "orphan", "unsorted"}, 40: paths, 50: paths, 51: paths | {"unsorted"}, 52: paths | {"unsorted"},
        53: {"bad-tag a<b", "bad-value area=a/b", "reserved-key kind", "orphan"}, 54: {"no-tags"},
    }


def test_name_matches_are_dealt_by_their_number(spark):
    """A few small tiles give many rows: AQE, which sees their bytes, must not put all of them into one task."""
    named = spark.range(400).selectExpr("id AS site_id", "concat('n', id % 40) AS name")
    symbol = spark.range(400).selectExpr("concat('m.', id, '.n', id % 40) AS id", "concat('m.n', id % 40) AS name")
    got = gv.name_matches(named, symbol).withColumn("task", F.spark_partition_id())
    rows = got.collect()
    assert len(rows) == 40 * 10 * 10 and len({(x.site_id, x.target) for x in rows}) == 4000 and {x.candidates for x in rows} == {10}
    assert len({x.task for x in rows}) == 4


def test_copies_of_name_lists_are_not_broadcast(spark, monkeypatch):
    """Few symbols, whose lists are copied for each tile of sites: the copies are shuffled with the sites."""
    monkeypatch.setattr(gv, "SITE_TILE", 8)
    named = spark.range(1_000).selectExpr("id AS site_id", "concat('n', id % 2) AS name")
    symbol = spark.range(4_000).selectExpr("concat('m.', id) AS id", "concat('m.n', id % 2) AS name")
    got = gv.name_matches(named, symbol)
    rows = got.collect()
    assert len(rows) == len({(r["site_id"], r["target"]) for r in rows}) == 1_000 * 2_000
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    joins = [x for x in plan.splitlines() if "Join" in x and "x#" in x and "y#" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)
    assert {r["candidates"] for r in rows} == {2_000}
