"""Single operators on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import symbols as sym
from graphloom.functions import text as txt
from graphloom.operators import attribution as att
from graphloom.operators import changes as chg
from graphloom.operators import expansion as exp
from graphloom.operators import facets as fac
from graphloom.operators import folds
from graphloom.operators import graph_views as gv
from graphloom.operators import names as nam
from graphloom.operators import quality_checks as chk
from graphloom.operators import regressions as reg
from graphloom.operators import resolution as res
from graphloom.operators import sessions as ses
from graphloom.operators import syntax_context as syn


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_innermost_ties(spark):
    refs = spark.createDataFrame([(1, "a", 5, 3), (2, "a", 9, 0), (3, "b", 5, 3), (4, "a", 300, 1)], "ref_id long, path string, line int, character int")
    defs = spark.createDataFrame([("a", "outer", 0, 0, 400, 0, 0), ("a", "b", 5, 0, 9, 0, 1), ("a", "a", 5, 0, 9, 0, 2), ("a", "wide", 5, 0, 12, 0, 3)], "path string, symbol string, start_line int, start_character int, end_line int, end_character int, pos int")
    assert rows(att.attribute_innermost(refs, defs)) == [(1, "a"), (2, "a"), (4, "outer")]  # inclusive end, earliest end, smallest symbol
    assert rows(att.locate_definition(refs, defs)) == [(1, "wide"), (2, "wide"), (4, "outer")]  # half-open, last in order
    assert rows(att.outside_definition(refs, att.attribute_innermost(refs, defs)), "ref_id") == [(3,)]
    assert rows(att.documents_without_attribution(refs, att.attribute_innermost(refs, defs))) == [("b",)]


def test_skip_precedence(spark):
    occ = spark.createDataFrame([("local 1", 1, None, True, True), ("f", 1, None, True, True), ("f", 0, False, True, True), ("f", 0, None, False, True), ("f", 0, None, True, False), ("f", 0, None, True, True)], "symbol string, roles int, is_name boolean, callable boolean, inside boolean")
    got = [r[0] for r in occ.select(att.skip_reason(*[F.col(c) for c in occ.columns])).collect()]
    assert got == ["local", "definition", "operator", "non_callable", "outside_definition", None]


@pytest.mark.parametrize(("before", "now", "drop"), [(10, 5, False), (10, 4, True), (0, 0, False), (1, 0, True), (11, 5, True), (-1, 0, False)])
def test_is_drop(spark, before, now, drop):
    assert one(spark, reg.is_drop(F.lit(before), F.lit(now))) is drop


def test_regressions_and_differences(spark):
    schema = "provider string, path string, edge_count long"
    old = spark.createDataFrame([("p", "kept", 4), ("p", "fell", 9), ("p", "lost", 3), ("p", "deleted", 3), ("p", "none", 0)], schema)
    new = spark.createDataFrame([("p", "kept", 4), ("p", "fell", 4), ("p", "new", 1)], schema)
    there = spark.createDataFrame([("kept",), ("fell",), ("lost",), ("none",)], "path string")
    drops, diffs = reg.edge_regressions(old, new, there), reg.edge_diff(old, new)
    assert rows(drops) == [("p", "fell", 9, 4), ("p", "lost", 3, None)]
    assert rows(diffs, "path", "expected", "found") == [("deleted", 3, None), ("fell", 9, 4), ("lost", 3, None), ("new", None, 1), ("none", 0, None)]
    assert rows(reg.report_passed(drops, diffs)) == [(False,)] and rows(reg.report_passed(drops.limit(0), diffs.limit(0))) == [(True,)]
    assert ("drop p lost: 3 -> none",) in rows(reg.drop_lines(drops), "line")
    gens = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True), (5, False)], "n long, complete boolean")
    assert rows(reg.previous_generation(gens), "n", "previous") == [(1, None), (2, 1), (3, 1), (4, 3), (5, 4)]
    assert rows(reg.retention(gens).where("kept"), "n") == [(3,), (4,)]


def test_resolution_keeps_null_groups_apart_from_totals(spark):
    site = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "y"), (4, "c", "z")], "site_id long, file string, caller string")
    target = spark.createDataFrame([(1, "t", "scip"), (2, "t", "name-match"), (3, "t", "vta"), (3, "u", "name-match")], "site_id long, target string, method string")
    file = spark.createDataFrame([("a", "rust"), ("b", None)], "path string, language string")
    symbol = spark.createDataFrame([("x", "m", "p"), ("y", None, "p")], "id string, module string, package string")
    report = res.resolution_rollup(res.resolution_by_module(site, target, file, symbol))
    assert rows(report, "level", "language", "call_sites", "unresolved") == [("language", "rust", 2, 1), ("language", None, 2, 1), ("total", None, 4, 2)]
    assert rows(reg.resolution_lines(report)) == [("rust 2 1 50.0%",), ("total 4 2 50.0%",), ("unknown 2 1 50.0%",)]
    assert rows(res.unresolved_by_module(site, target, symbol)) == [("m", 1, 2)]


SYMBOLS = {
    "local 3": (None, "other"),
    "rust-analyzer cargo my-crate 0.1.0 crate/": ("my_crate", "type"),
    "rust-analyzer cargo my-crate 0.1.0 a/Order#": ("my_crate.a.Order", "type"),
    "rust-analyzer cargo my-crate 0.1.0 a/impl#[Order][Apply]apply().": ("my_crate.a.Order.Apply.apply", "fn"),
    "rust-analyzer cargo my-crate 0.1.0 a/impl#[Order]": (None, "type"),
    "rust-analyzer cargo my-crate 0.1.0 a/f().(x)": (None, "other"),
    "scip-go gomod example.com/x . `a/b`/T#run().": ("a.b.T.run", "fn"),
    "scip-go gomod example.com/x . `a/b`/T#size.": ("a.b.T.size", "field"),
    "scip-typescript npm pkg 1.0.0 `x.ts`/over(+1).": ("x.ts.over+1", "fn"),
    "scip-python python pkg 1.0 `a``b`/x.": ("a`b.x", "const"),
    "s m p v `a b`/c!": ("a b.c", "other"),
}


def test_symbols(spark):
    df = spark.createDataFrame([(s,) for s in SYMBOLS], "symbol string")
    p = F.col("parsed")
    got = sym.parse_symbols(df).select("symbol", sym.canonical_name(p), sym.namespace_class(p, F.lit(None).cast("string")), sym.format_symbol(p), sym.dispatch_class(p), F.col("parsed.error")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == SYMBOLS
    assert all(r[0] == r[3] and r[5] is None for r in got)
    dispatch = {r[0].rpartition(" ")[2]: r[4] for r in got}
    assert dispatch["a/impl#[Order][Apply]apply()."] == "static" and dispatch["`a/b`/T#run()."] == "unknown" and dispatch["a/Order#"] == "unknown"


def test_malformed_symbols_name_the_byte(spark):
    bad = ["", "a b c", "s m p v ", "s m p v x", "s m p v `x", "local a b", "s m p v f(", "s m p v é."]
    got = sym.malformed(sym.parse_symbols(spark.createDataFrame([(s,) for s in bad], "symbol string")))
    assert {r["symbol"] for r in got.collect()} == set(bad) and all("byte" in r["error"] for r in got.collect())


def test_module_ancestors(spark):
    df = spark.createDataFrame([("rust-analyzer cargo c 1 crate/a/b/f().",), ("scip-go gomod g . a/b/T#x.",), ("s m p v f().",)], "symbol string")
    got = dict(rows(sym.parse_symbols(df).select("symbol", sym.module_ancestors(F.col("parsed")))))
    assert list(got.values()) == [["c.a", "c.a.b"], [], ["a", "a.b"]] or set(map(tuple, got.values())) == {("c.a", "c.a.b"), ("a", "a.b"), ()}


def test_names(spark):
    df = spark.createDataFrame([("t", "x", "type"), ("f", "x", "fn"), ("d", "x", "field"), ("m", "x", "other"), ("g", "y", "fn"), ("h", "y", "fn"), ("l", None, "other")], "symbol string, base string, class string")
    got = nam.assign_names(df)
    assert dict(rows(got, "symbol", "name")) == {"t": "x", "f": "x+fn", "d": "x+field", "m": "x", "g": "y", "h": "y", "l": None}
    assert rows(nam.name_collisions(got)) == [("x", ["m", "t"]), ("y", ["g", "h"])] and rows(nam.unique_names(got)) == [("x+field", "d"), ("x+fn", "f")]


def test_fnv24_golden(spark):
    assert one(spark, nam.fnv24(F.lit("sym:billing.Order"), F.lit(0))) == "d2e75b"


def test_case_fold_suffixes(spark):
    df = spark.createDataFrame([("d", "Order", "1"), ("d", "order", "2"), ("d", "other", "3"), ("e", "Order", "4")], "dir string, name string, id string")
    got = {r["id"]: r["final"] for r in nam.case_fold_suffixes(df).collect()}
    assert got["3"] == "other" and got["4"] == "Order" and got["1"].startswith("Order~") and got["2"].startswith("order~")
    assert len({(x.lower()) for x in got.values()}) == 4 or got["4"] == "Order"


def test_text(spark):
    assert one(spark, txt.from_windows_name(txt.to_windows_name(F.lit('a<b>:"|?*c')))) == 'a<b>:"|?*c'
    for name in ("plain", "with space", 'quo"te', "back\\slash and space", "\\"):
        got = one(spark, txt.decode_item_id(txt.encode_item_id(F.lit("sym"), F.lit(name))))
        assert (got["space"], got["name"], got["error"]) == ("sym", name, None)
    errors = {s: one(spark, txt.decode_item_id(F.lit(s)))["error"] for s in ("x:a", "sym:", 'sym:"a', 'sym:"a\\n"')}
    assert list(errors.values()) == ["unknown-space", "empty-name", "unclosed-quote", "bad-escape"]
    assert [one(spark, txt.is_called(F.lit(s))) for s in ("(x)", "  (", "::<A>(b)", "::<A<B>, C> (b)", "::<A", ".x(", "::<A>.b(", "")] == [True, True, True, True, False, False, False, False]
    assert [one(spark, txt.is_name(F.lit("a+é_ "), F.lit(i), F.lit(i + 1))) for i in range(6)] == [True, False, True, True, False, None]
    assert [one(spark, txt.unquote_literal(F.lit(s))) for s in ("'a'", 'r#"x"#', 'b"y"', '"""z"""', "`t`", "1")] == ["a", "x", "y", "z", "t", "1"]
    assert [one(spark, txt.relative_uri(F.lit(u), F.lit("/r"))) for u in ("file:///r/a%20b+c", "file:///s/a", "http://r/a")] == ["a b+c", None, None]
    assert [one(spark, txt.source_tag(F.lit(t))) for t in ("rust-analyzer 1.2 (x)", "tool", "", None)] == ["scip@rust-analyzer-1.2", "scip@tool", "scip@unknown", "scip@unknown"]
    sources = {"rust": ("pub fn a", "fnord a"), "go": ("func (r) x", "function"), "python": ("async def f", "undef f"), "typescript": ("x => 1", "functional")}
    assert all(one(spark, txt.declares_function(F.lit(k), F.lit(y))) and not one(spark, txt.declares_function(F.lit(k), F.lit(n))) for k, (y, n) in sources.items())


def test_byte_offset(spark):
    lines = txt.line_offsets(spark.createDataFrame([("a", "é😀x\nab")], "path string, text string"))
    at = lambda columns, line, enc: [r["byte"] for r in sorted(txt.byte_offset(lines, spark.createDataFrame([("a", line, c) for c in columns], "path string, line int, column int"), enc).collect(), key=lambda r: r["column"])]
    assert at([0, 1, 2, 3, 4, 5], 0, "utf-16") == [0, 2, None, 6, 7, None]
    assert at([0, 1, 2, 6, 7, 8], 0, "utf-8") == [0, 1, 2, 6, 7, None] and at([1, 2, 3], 1, "utf-8") == [9, 10, None]


def test_expansion(spark):
    site = spark.createDataFrame([(1, 1, "m"), (2, 1, "m"), (3, 1, "n"), (4, 2, "m")], "site_id long, run_id int, declared_target string")
    impls = spark.createDataFrame([("m", "i1"), ("m", "i1"), ("m", "m"), ("m", "unknown"), ("n", "i2")], "method string, implementation string")
    symbol = spark.createDataFrame([("m", "trait_method", "f"), ("i1", "method", "f"), ("i2", "method", "f"), ("n", "trait_method", None)], "id string, kind string, file string")
    targets = exp.expand_targets(site, impls, symbol, 1)
    assert rows(targets) == [(1, "i1", "lsp-impl"), (2, "i1", "lsp-impl"), (3, "i2", "lsp-impl")]
    methods = exp.called_trait_methods(site, symbol, 1)
    assert rows(methods) == [("m",)] and rows(exp.expansion_summary(targets, methods)) == [(1, 2, 3, 3)]


def test_checks(spark):
    run = spark.createDataFrame([(1, "succeeded"), (1, "ok")], "run_id int, status string")
    site = spark.createDataFrame([(1, 1, "call", "static"), (2, 7, "call", "static")], "site_id long, run_id int, ref_kind string, dispatch string")
    got = rows(chk.check_constraints({"run": run, "call_site": site}))
    assert got == [("call_site", "references run", "7"), ("run", "check status", "ok"), ("run", "primary key", "1")]
    target = spark.createDataFrame([(1, "f", "declared"), (1, "f", "bogus"), (2, None, "cha"), (None, "g", "scip")], "site_id long, target string, method string")
    got = rows(chk.check_constraints({"call_site": site, "call_target": target}))
    assert got == [("call_target", "check method", "bogus"), ("call_target", "check method", "scip"), ("call_target", "not null site_id", "1"), ("call_target", "not null target", "1")]
    none = run.limit(0)
    assert rows(chk.check_call_graph(none, run, run, run)) == [("no files",)] and rows(chk.check_call_graph(run, run, run, none)) == [("no function edges",)] and not rows(chk.check_call_graph(run, run, run, run))
    refs = spark.createDataFrame([("b", True), ("a", True), ("0", False)], "path string, callable boolean")
    assert rows(chk.check_edges(none, refs)) == [("no call edges, though functions are referenced in a",)] and not rows(chk.check_edges(run, refs))


@pytest.mark.parametrize(("a", "b", "both"), [("created", "changed", "created"), ("created", "deleted", "none"), ("changed", "changed", "changed"), ("changed", "deleted", "deleted"), ("deleted", "created", "changed"), ("deleted", "deleted", "deleted"), ("created", "created", "created"), ("changed", "created", "created"), ("deleted", "changed", "changed")])
def test_merge_kinds(spark, a, b, both):
    assert one(spark, folds.state_of(folds.compose(folds.table_of(F.lit(a)), folds.table_of(F.lit(b))))) == both


def test_changes(spark):
    schema = "path string, is_dir boolean, len long, modified long"
    old = spark.createDataFrame([("a", True, 0, 1), ("a/x", False, 1, 1), ("ab", False, 1, 1), ("t", True, 0, 0), ("t/y", False, 1, 1), ("gone", False, 1, 1)], schema)
    new = spark.createDataFrame([("a", True, 0, 9), ("a/x", False, 2, 1), ("ab", False, 1, 1), ("t", False, 0, 0), ("new", False, 1, 1)], schema)
    assert rows(chg.snapshot_diff(old, new)) == [("a/x", "changed"), ("gone", "deleted"), ("new", "created"), ("t", "changed"), ("t/y", "deleted")]
    dirs = spark.createDataFrame([("a",)], "dir string")
    assert rows(chg.subtree(old, dirs)) == [("a", "a"), ("a", "a/x")] and rows(chg.cascade_delete(dirs, old)) == [("a/x", "deleted")]
    seen = spark.createDataFrame([("t", False, 0, 0), ("gone", None, None, None), ("new", False, 1, 1), ("ab", False, 1, 1)], schema)
    assert rows(chg.classify_change(seen, old)) == [("gone", "deleted"), ("new", "created"), ("t", "created"), ("t", "deleted"), ("t/y", "deleted")]
    assert rows(chg.advance_baseline(old, chg.snapshot_diff(old, new), new)) == [("a", True, 0, 1), *rows(new.where("path <> 'a'"))]
    kinds = {p: one(spark, chg.classify_path(F.lit(p), ["build"], ["node_modules"])) for p in (".git/index.lock", "build/x", "builder", "a/node_modules/b")}
    assert list(kinds.values()) == ["index-lock", "excluded", "watched", "excluded"]


def test_sessions(spark):
    schema = "pos long, ts_ms long, sender string, kind string, method string, id string, body string"
    m = spark.createDataFrame([(1, 10, "client", "request", "a", "1", None), (2, 15, "server", "response", None, "1", "x"), (3, 18, "server", "response", None, "1", "late"), (4, 20, "client", "request", "a", '"1"', None), (5, 30, "server", "request", "b", "1", None), (6, 33, "client", "response", None, "1", "y"), (7, 40, "client", "request", "a", "2", None), (8, 47, "server", "response", None, "2", "w")], schema)
    pairs = ses.pair_requests(m)
    assert rows(pairs, "pos", "answer_pos", "latency_ms") == [(1, 2, 5), (4, None, None), (5, 6, 3), (7, 8, 7)]
    assert rows(ses.latency_stats(pairs)) == [("a", 2, 5, 7, 7), ("b", 1, 3, 3, 3)]  # the upper median
    assert rows(ses.answers_by_method(pairs)) == [("a", ["x", "w"]), ("b", ["y"])]
    marks = spark.createDataFrame([(15, "one"), (35, "two"), (900, "none")], "ts_ms long, step string")
    assert dict(rows(ses.assign_step(m, marks), "pos", "step")) == {1: "startup", 2: "one", 3: "one", 4: "one", 5: "one", 6: "one", 7: "two", 8: "two"}
    opened = spark.createDataFrame([(n, ts, sender, "notification", "textDocument/didOpen", uri) for n, ts, sender, uri in ((9, 42, "client", "y"), (10, 41, "client", "x"), (11, 43, "server", "z"))], "pos long, ts_ms long, sender string, kind string, method string, uri string")
    said = m.unionByName(opened, allowMissingColumns=True)
    assert rows(ses.step_summary(said, marks)) == [("none", "none", "none", "none"), ("one", "none", "a", "none"), ("startup", "none", "a", "none"), ("two", "didOpen y, didOpen x", "a", "none")]
    assert rows(ses.document_sync_pivot(said), "uri", "didOpen") == [("x", 1), ("y", 1)]
    life = spark.createDataFrame([(1, "start", "{}"), (2, "exit", "{}"), (3, "note", "{}")], "ts_ms long, event string, value string")
    assert rows(ses.lifecycle_events(life), "event") == [("exit",), ("start",)]


def test_numbers_of_huge_keys(spark):
    sites = spark.range(3000).selectExpr("id AS site_id", "if(id % 7 = 0, 'b', 'a') AS caller", "if(id % 2 = 0, 'y', 'x') AS file", "cast(id * 37 % 1000 AS int) AS line", "cast(id % 5 AS int) AS col", "'t' AS declared_target")
    made = [(r["caller"], r["file"], r["line"], r["col"], r["site_id"], r["ordinal"]) for r in att.number_sites(sites).collect()]
    for caller in "ab":
        assert [r[-1] for r in sorted(r for r in made if r[0] == caller)] == list(range(1, 1 + sum(r[0] == caller for r in made)))
    ids = sorted((r["file"], r["line"], r["col"], r["site_id"], r["new_id"]) for r in att.assign_ids(sites, 10, "file", ["line", "col", "site_id"]).collect())
    assert [r[-1] for r in ids] == list(range(11, 3011))


def test_facets(spark):
    tags = spark.createDataFrame([("x", "k", "1"), ("x", "k", "2"), ("y", "k", "10"), ("z", "p", "a.b")], "item string, key string, value string")
    pick = lambda f: [r[0] for r in rows(fac.select_items(tags, f))]
    assert pick(fac.facet_eq("k", "1") & fac.facet_eq("k", "2")) == ["x"] and pick(~fac.facet_has("k")) == ["z"]
    assert pick(fac.facet_gt("k", 5) | fac.facet_path("p", "a.b")) == ["y", "z"] and pick(fac.facet_ne("k", "1")) == ["x", "y"]


def test_graph_views(spark):
    graph = spark.createDataFrame([("a.x", "a.y", 3), ("a.x", "b.z", 5), ("b.q", "a.x", 5), ("c", "a.x", 1)], "from_module string, to_module string, calls long")
    assert rows(gv.collapse_modules(graph, 1)) == [("a", "b", 5), ("b", "a", 5), ("c", "a", 1)]
    assert rows(gv.heaviest_edges(graph, 2)) == [("a.x", "b.z", 5), ("b.q", "a.x", 5)] and rows(gv.elided_edges(graph, 2)) == [(2, 4)]
    base, left, right = (spark.createDataFrame(x, "item string, tag string") for x in ([("i", "a"), ("j", "a"), ("k", "a")], [("i", "b"), ("j", "a"), ("k", "b")], [("i", "a"), ("j", "c"), ("k", "c")]))
    assert rows(gv.merge_tags(base, left, right)) == [("i", ["b"], False), ("j", ["c"], False), ("k", [], True)]
    ops = spark.createDataFrame([("mv", "file:d", "file:e"), ("mv", "file:d/special", "file:s"), ("tag", "file:z", "n"), ("untag", "file:q", "a")], "op string, item string, arg string")
    now = spark.createDataFrame([("file:d/x", "a"), ("file:d/special", "a"), ("file:dd", "a"), ("file:q", "a")], "item string, tag string")
    assert rows(gv.apply_tag_ops(now, ops)) == [("file:dd", "a"), ("file:e/x", "a"), ("file:s", "a"), ("file:z", "n")]


def test_syntax_context(spark):
    nodes = spark.createDataFrame([("f", 1, None, "fn", None, 0, 100), ("f", 2, 1, "if", "body", 10, 90), ("f", 3, 2, "while", "condition", 20, 80), ("f", 4, 3, "call", "body", 30, 60), ("f", 5, None, "if", None, 0, 200)], "file string, node_id long, parent_id long, kind string, field string, start long, end_at long")
    sites = spark.createDataFrame([(1, "f", 35), (2, "f", 15), (3, "f", 150), (4, "g", 1)], "site_id long, file string, at long")
    kinds = spark.createDataFrame([("if", "conditional", "all", []), ("while", "loop", "except", ["condition"])], "kind string, control string, mode string, fields array<string>")
    assert rows(syn.control_context(sites, nodes, kinds, ("fn",))) == [(1, ["loop", "conditional"]), (2, ["conditional"]), (3, ["conditional"]), (4, [])]
    only = kinds.withColumn("mode", F.lit("only")).withColumn("fields", F.array(F.lit("body")))
    assert rows(syn.control_context(sites, nodes, only, ("fn",)))[0] == (1, ["loop"])
    assert rows(syn.site_call(sites, nodes, ("call",))) == [(1, 4)]
    callee = spark.createDataFrame([(4, 30, 34)], "node_id long, start long, end_at long")
    assert rows(syn.site_call(sites, nodes, ("call",), callee)) == []
    strings = spark.createDataFrame([(10, 4, "string", 40, '"a"'), (11, 4, "string", 45, '"b{x}"'), (12, 11, "interpolation", 46, "x"), (13, 4, "string", 42, "'c'")], "node_id long, parent_id long, kind string, start long, text string")
    assert rows(syn.literal_arguments(spark.createDataFrame([(4,)], "call long"), strings, ("string",), ("interpolation",))) == [(4, ["a", "c"])]


def test_json_and_logs(spark):
    body = json.dumps({"result": {"x": [1, 2]}})
    assert one(spark, txt.json_path(F.lit(body), "result.x")) is not None and one(spark, txt.json_path(F.lit(body), "result.y")) is None
    assert one(spark, txt.describe_response(F.lit(json.dumps({"error": {"code": 1, "message": "m"}})))) == "error 1 m"
    assert one(spark, txt.describe_response(F.lit(json.dumps({"result": "x" * 200})))) == "result (202 bytes)"
    lines = ["Error: a", "x aborting", "Analysis errors: 0, ok", "Analysis errors: 2, bad", "info: skipping file 'a b' because it has byte size 9", "fine"]
    got = txt.log_failures(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert rows(got) == sorted([(lines[0], None), (lines[1], None), (lines[3], None), (lines[4], "a b")], key=repr)
