"""Report documents as whole texts, verdicts on a session, and places in UTF-16."""

import json
from glob import glob

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import sessions
from graphloom.sources import reports


def whole(folder):
    return "".join(open(f).read() for f in sorted(glob(f"{folder}/part-*")))


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


COUNTS = "call_sites long, resolved long, unresolved long"


def test_a_report_is_one_json_text(spark, tmp_path):
    modules = [("rust", None, None, 4, 3, 1), ("rust", "p", "a.\"b\"", 3, 0, 3), (None, "p", "a", 0, 0, 0), ("go", "p", None, 6, 6, 0)]
    edges = [("rust", f"src/{n}.rs", n) for n in range(300)] + [("go", "a\\b\".go", 7)]
    lines = reports.report_lines(
        5, table(spark, modules, f"language string, package string, module string, {COUNTS}"), table(spark, [("rust", 7, 3, 4), ("go", 6, 6, 0)], f"language string, {COUNTS}"), table(spark, [(13, 9, 4)], COUNTS), 4,
        table(spark, [("rust", "x", 9, None), ("go", "y", 9, 1)], "provider string, path string, previous long, current long"), table(spark, [], "provider string, path string, expected long, found long"), table(spark, edges, "provider string, path string, edge_count long"),
    )
    reports.write_document(lines, f"{tmp_path}/r")
    got = json.loads(whole(f"{tmp_path}/r"))
    assert list(got) == ["generation", "modules", "languages", "total", "regression", "baseline", "edge_counts"] and got["generation"] == 5
    assert [(m["language"], m["package"], m["module"], m["unresolved_rate"]) for m in got["modules"]] == [(None, "p", "a", None), ("go", "p", None, 0.0), ("rust", None, None, 0.25), ("rust", "p", 'a."b"', 1.0)]
    assert [x["language"] for x in got["languages"]] == ["go", "rust"] and got["total"] == {"call_sites": 13, "resolved": 9, "unresolved": 4, "unresolved_rate": 0.307692}
    assert got["regression"] == {"previous": 4, "threshold_percent": 50, "drops": [{"provider": "go", "path": "y", "previous": 9, "current": 1}, {"provider": "rust", "path": "x", "previous": 9, "current": None}]}
    assert got["baseline"] == {"differences": []} and got["edge_counts"] == {"go": {'a\\b".go': 7}, "rust": {f"src/{n}.rs": n for n in range(300)}}
    assert list(got["edge_counts"]["rust"]) == sorted(got["edge_counts"]["rust"])


def test_reports_without_rows_or_baseline(spark, tmp_path):
    none = table(spark, [], f"language string, package string, module string, {COUNTS}, provider string, path string, previous long, current long, edge_count long")
    reports.write_document(reports.report_lines(1, none, none, none.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("call_sites", "resolved", "unresolved")]), None, none, None, none), f"{tmp_path}/r")
    assert json.loads(whole(f"{tmp_path}/r")) == {"generation": 1, "modules": [], "languages": [], "total": {"call_sites": 0, "resolved": 0, "unresolved": 0, "unresolved_rate": None}, "regression": {"previous": None, "threshold_percent": 50, "drops": []}, "baseline": None, "edge_counts": {}}
    reports.write_document(reports.baseline_lines(table(spark, [("go", "b", 2), ("go", "a", 1)], "provider string, path string, edge_count long")), f"{tmp_path}/b")
    assert json.loads(whole(f"{tmp_path}/b")) == {"go": {"a": 1, "b": 2}}


MESSAGE = "session string, pos long, sender string, kind string, method string, id string, msg string"


def verdicts(spark, rows):
    df = table(spark, [("s", n, *r) for n, r in enumerate(rows)], MESSAGE)
    return {r["check"]: (r["verdict"], r["detail"]) for r in sessions.session_verdicts(df).collect()}


def test_verdicts_on_a_session(spark):
    init = lambda params: ("client", "request", "initialize", "0", json.dumps({"params": params}))
    doc = lambda what, uri: ("client", "notification", f"textDocument/{what}", "", json.dumps({"params": {"textDocument": {"uri": uri}}}))
    ask = lambda m, i: ("server", "request", m, i, "{}")
    answer = lambda i, msg: ("client", "response", "", i, json.dumps(msg))
    unknown = {"error": {"code": -32601}}
    got = verdicts(spark, [
        init({"capabilities": {}, "rootUri": None}), init({"capabilities": {"workspace": {"didChangeWatchedFiles": 1}}}), doc("didChange", "a"), doc("didOpen", "a"), doc("didOpen", "b"),
        ask("workspace/configuration", "1"), answer("1", unknown), answer("1", {"result": []}), ask("client/registerCapability", "2"), answer("2", {"result": None}), ask("client/registerCapability", '"2"'), answer('"2"', unknown),
    ])
    assert got == {
        "workspace.didChangeWatchedFiles": ("CONFIRMED", "absent"), "rootUri": ("CONFIRMED", "null"), "workspace/configuration": ("CONFIRMED", "1 of 1"), "client/registerCapability": ("REFUTED", "1 of 2"),
        "window/workDoneProgress/create": ("NOT OBSERVED", None), "didChange after didOpen": ("CONFIRMED", "0 of 2"),
    }
    got = verdicts(spark, [init({"capabilities": {"workspace": {"didChangeWatchedFiles": None}}, "rootUri": "file:///p"}), doc("didOpen", "a"), doc("didChange", "a"), ask("workspace/configuration", "1")])
    assert got["workspace.didChangeWatchedFiles"] == ("REFUTED", "null") and got["rootUri"] == ("REFUTED", '"file:///p"') and got["didChange after didOpen"] == ("REFUTED", "1 of 1") and got["workspace/configuration"] == ("REFUTED", "0 of 1")
    got = verdicts(spark, [("server", "notification", "x", "", "not json")])
    assert got["rootUri"] == ("NOT OBSERVED", "no initialize") and {v for v, _ in got.values()} == {"NOT OBSERVED"}


@pytest.mark.parametrize("line", ["", "plain", "é\U0001f600x", "\U0001f600\U0001f600", "日本語"])
def test_places_in_both_encodings(spark, line):
    units, raw = line.encode("utf-16-le"), line.encode()
    wants = []
    for c in range(-1, len(raw) + 3):
        cut = [i for i in range(len(line) + 1) if len(line[:i].encode("utf-16-le")) == 2 * c]
        wants.append((c, 10 + len(line[: cut[0]].encode()) if cut else None, 10 + c if 0 <= c <= len(raw) else None))
    lines = spark.createDataFrame([("f", 1, line, 10)], "path string, line int, text string, offset long")
    at = spark.createDataFrame([("f", 1, c) for c, _, _ in wants], "path string, line int, column int")
    got = {e: {r["column"]: r["byte"] for r in text.byte_offset(lines, at, e).collect()} for e in ("utf-16", "utf-8")}
    assert got == {"utf-16": {c: x for c, x, _ in wants}, "utf-8": {c: y for c, _, y in wants}} and len(units) // 2 <= len(raw)
