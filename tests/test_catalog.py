"""Registered queries against their SQL in DuckDB, over the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

from graphloom.functions import frames
from graphloom.functions.text import is_called
from graphloom.operators import names
from graphloom.plans import catalog, inputs, reports
from graphloom.plans.inputs import TABLES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.execute(f"SELECT {quoted} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(plain, got))) == sorted(map(repr, map(plain, want)))


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_call_graphs_of_all_orders(spark):
    got = catalog.queries()["read_call_graph_maps_of_all"](spark, DIR)
    assert got.count() == spark.read.parquet(f"{DIR}/orders.parquet").count()
    assert got.groupBy("path").count().where("count > 256").isEmpty()


def test_answers_are_whole(spark):
    got = catalog.queries()["first_answers"](spark, DIR)
    assert got.select("answer").distinct().count() > got.select(F.substring("answer", 1, 2)).distinct().count()


def test_is_called_reads_long_generics(spark):
    after = F.concat(F.lit("::<"), F.repeat(F.lit("a"), 1_000_100), F.lit(">("))
    assert spark.range(1).select(is_called(after).alias("x")).first()["x"]


@pytest.mark.parametrize("name", ["unresolved_rate", "module_edges", "result_set_callgraph", "list_call_targets", "derive_call_facets"])
def test_lines_are_numbered_once(spark, name):
    """Sites and targets of a query come from one written table of lines."""
    plan = catalog.queries()[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


def test_call_facets_are_not_dealt_by_their_text(spark):
    plan = catalog.queries()["derive_call_facets"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(item" not in plan and "hashpartitioning(site_id" in plan


def test_listed_sites_are_numbered_without_what_they_do_not_show(spark):
    """Lines are numbered by the columns up to the last that is read; those after it aren't shuffled."""
    plan = catalog.queries()["list_call_sites"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "row_number" in x and "Window" in x]
    assert windows and all("l_quantity" in x and "l_tax" not in x and "l_shipdate" not in x for x in windows)


def test_large_tables_are_dealt_to_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(frames, "TASK_ROWS", 100)
    table = spark.range(1_000).selectExpr("id", "id % 7 AS k")
    deal = frames.dealer(table)
    assert deal(table, "id").rdd.getNumPartitions() == 10
    assert frames.dealer(table.limit(300))(table, "id") is table
    line = catalog.relation(spark, DIR, "line")
    most = line.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 500 < line.count() / 8


@pytest.mark.parametrize("name", ["resolution_by_module", "report_json", "union_call_edges"])
def test_lines_are_written_once_and_dealt(spark, monkeypatch, name):
    """Lines are numbered in one place, and large ones are joined by site in more tasks than the session has partitions."""
    monkeypatch.setattr(frames, "TASK_ROWS", 500, raising=False)
    seen, plan = [], lambda df: df._jdf.queryExecution().executedPlan().toString()
    for module in (inputs, reports):
        monkeypatch.setattr(module, "checkpointed", lambda df: (seen.append(plan(df)), frames.checkpointed(df))[1], raising=False)
    seen.append(plan(catalog.queries()[name](spark, DIR)))
    assert sum(x.count("row_number() windowspec") for x in seen) == 1
    if name != "union_call_edges":
        assert any("REPARTITION_BY_NUM" in x and "hashpartitioning(site_id" in x for x in seen)


def test_a_summary_gathers_no_symbols(spark):
    plan = catalog.queries()["ingest_summary"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_" not in plan


def test_collided_names_have_several_symbols(spark):
    rows = [("a", "n"), ("b", "n"), ("a", "n"), ("c", "m"), ("c", "m"), ("d", None), ("e", None), (None, "m")]
    df = spark.createDataFrame(rows, "symbol string, name string")
    assert [x["name"] for x in names.collided_names(df).collect()] == ["n"] == [x["name"] for x in names.name_collisions(df).collect()]


def test_indexes_over_the_same_lines_share_their_last_lines(spark, monkeypatch):
    """What the flags of lines don't change is told once and written with them, not for each index over them."""
    r = lambda name, given=None, text=None: catalog.relation(spark, DIR, name, given, text)
    lines = catalog.code_lines(r)
    written = []
    monkeypatch.setattr(catalog, "checkpointed", lambda df: (written.append(df.columns), frames.checkpointed(df))[1])
    occ, info, _ = catalog.code_files(lines)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (occ, info)]
    assert "Window" not in plans[0] + plans[1] and written == [["path", "text"]]
