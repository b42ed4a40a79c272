"""The whole analysis of one small index."""

import pytest

from graphloom.operators import ingest
from graphloom.sources.readers import BadInput

# A text, and below it the places of its names, which have every reason for a skip.
SOURCE = """mod m {
    use crate::f;
    pub fn outer() {
        fn inner() { f(); }
        f(1 + 2);
        let g = f;
        helper::<u8>(x);
        far
            ::<A<B>> (y);
    }
}
"""
OWN, CORE = "rust-analyzer cargo demo 0.1.0 ", "rust-analyzer cargo core 1 "
MODULE, OUTER, INNER, F_, HELPER, FAR = (OWN + x for x in ("m/", "m/outer().", "m/outer().inner().", "f().", "helper().", "far()."))
ADD, PUSH = CORE + "ops/impl#[i32][Add]add().", CORE + "vec/Vec#push()."
OCC = "path string, doc_pos int, pos int, symbol string, range array<int>, enclosing_range array<int>, roles int"
INFO = "path string, doc_pos int, pos int, symbol string, kind string"


def index(spark, extra=(), infos=()):
    found = [
        (MODULE, [0, 4, 5], [0, 0, 10, 1], 1), (F_, [1, 15, 16], None, 0), (OUTER, [2, 11, 16], [2, 4, 9, 5], 1), (INNER, [3, 11, 16], [3, 8, 3, 27], 1),
        (F_, [3, 21, 22], None, 0), (F_, [4, 8, 9], None, 0), (ADD, [4, 11, 12], None, 0), (ADD, [4, 12, 13], None, 0), (ADD, [4, 13, 14], None, 0),
        ("local 0", [5, 12, 13], None, 0), (F_, [5, 16, 17], None, 0), (HELPER, [6, 8, 14], None, 0), ("local 1", [6, 21, 22], None, 0), (FAR, [7, 8, 11], None, 0), *extra,
    ]
    occ = spark.createDataFrame([("a.rs", 0, i, s, r, e, roles) for i, (s, r, e, roles) in enumerate(found)], OCC)
    info = spark.createDataFrame([("a.rs", 0, i, s, k) for i, (s, k) in enumerate([(MODULE, "Module"), (OUTER, "Function"), (INNER, "Function"), *infos])], INFO)
    return occ, info, spark.createDataFrame([("a.rs", SOURCE)], "path string, text string")


def test_index_becomes_symbols_sites_and_counts(spark):
    got = ingest.analyze(*index(spark, [(PUSH, [8, 22, 23], None, 0), (OWN + "Kind#", [6, 17, 19], None, 0)]))
    sites = sorted((r["line"], r["caller"].removeprefix(OWN), r["ref_kind"], r["declared_target"].removeprefix(OWN), r["ordinal"]) for r in got["sites"].collect())
    assert sites == [
        (4, "m/outer().inner().", "call", "f().", 1),
        (5, "m/outer().", "call", "f().", 1),
        (6, "m/outer().", "value", "f().", 2),
        (7, "m/outer().", "call", "helper().", 3),
        (8, "m/outer().", "call", "far().", 4),
        (9, "m/outer().", "value", PUSH, 5),
    ]
    assert {r["reason"]: r["n"] for r in got["skipped"].collect()} == {"local": 2, "operator": 3, "non_callable": 1, "outside_definition": 1}
    table = {r["symbol"]: r for r in got["symbols"].collect()}
    assert set(table) == {MODULE, OUTER, INNER, F_, HELPER, FAR, PUSH} and got["collisions"].isEmpty()
    outer, push = table[OUTER], table[PUSH]
    assert (outer["name"], outer["kind"], outer["file"], outer["start_line"], outer["end_line"], outer["modules"], outer["external"]) == ("demo.m.outer", "function", "a.rs", 3, 10, ["demo.m"], False)
    assert (push["name"], push["package"], push["file"], push["modules"], push["external"]) == ("core.vec.Vec.push", "core", None, ["core.vec"], True)
    assert table[F_]["kind"] == "function" and not table[F_]["external"]


def test_colliding_names_are_kept_and_told(spark):
    twin = OWN + "`m.outer`()."
    got = ingest.analyze(*index(spark, infos=[(twin, "Function")]))
    assert [(r["name"], r["symbols"]) for r in got["collisions"].collect()] == [("demo.m.outer", sorted([OUTER, twin]))]


def test_a_broken_symbol_fails(spark):
    with pytest.raises(BadInput, match="broken"):
        ingest.analyze(*index(spark, [("broken", [8, 0, 1], None, 0)]))


RUN = "run_id int, provider string, provider_version string, args array<string>, started_at timestamp, finished_at timestamp, status string"
NAMES = ("run_file", "file", "symbol", "call_site", "call_target")


def tree(spark, texts, kinds=()):
    """An index of files of one function each, `fn NAME() { CALLS }`, with the kinds of symbols; and its file table."""
    occ, info = [], [(path, 0, n, OWN + s, k) for n, (path, s, k) in enumerate(kinds)]
    for path, (name, calls) in texts.items():
        own = OWN + name + "()."
        occ.append((path, 0, 0, own, [0, 3, 3 + len(name)], [0, 0, 9, 0], 1))
        info.append((path, 0, 100, own, "Function"))
        for n, call in enumerate(calls):
            occ.append((path, 0, n + 1, OWN + call.rstrip("(;") + "().", [n + 1, 2, 2 + len(call.rstrip("(;"))], None, 0))
    whole = [(path, f"fn {name}() {{\n" + "".join(f"  {c}\n" for c in calls) + "}\n") for path, (name, calls) in texts.items()]
    sources = spark.createDataFrame(whole, "path string, text string")
    files = sources.selectExpr("path", "'rust' AS language", "sha2(text, 256) AS content_hash", "cast(length(text) as long) AS size")
    return spark.createDataFrame(occ, OCC), spark.createDataFrame(info, INFO), sources, files


def generation(spark, built, number, previous=None, sources=None):
    run = spark.createDataFrame([(number, "rust", "1", [], None, None, "succeeded")], RUN)
    occ, info, texts, files = built
    return ingest.generation(occ, info, sources or texts, files, run, "scip@rust", previous)


def rows_of(df, without=()):
    return sorted((tuple(r) for r in df.drop(*without).collect()), key=repr)


OLD = {"a.rs": ("a", ["f(", "g;", "h("]), "b.rs": ("b", ["f(", "x("]), "c.rs": ("c", ["g("])}
NEW = {"a.rs": ("a", ["f(", "g(", "k(", "h("]), "b.rs": ("b", ["f(", "x("]), "d.rs": ("d", ["a("])}


def test_incremental_generations_equal_whole_ones(spark, tmp_path):
    from graphloom.sources import snapshots

    root = f"{tmp_path}/gens"
    snapshots.publish_generation(spark, generation(spark, tree(spark, OLD), 1), root)
    before = snapshots.read_generation(spark, root)
    asked = []
    built = tree(spark, NEW)
    got = generation(spark, built, 2, before, lambda paths: asked.extend(sorted(r["path"] for r in paths.collect())) or built[2].join(paths, "path", "left_semi"))
    assert asked == ["a.rs", "d.rs"]
    snapshots.publish_generation(spark, got, root)
    got, want = snapshots.read_generation(spark, root), generation(spark, built, 2)
    for name in NAMES:
        assert rows_of(got[name], ["site_id"]) == rows_of(want[name], ["site_id"]), name
    for name in ingest.STATE:
        assert rows_of(got[name]) == rows_of(want[name]), name
    ids = lambda t: {(r["file"], r["line"], r["declared_target"]): r["site_id"] for r in t["call_site"].collect()}
    old, new = ids(before), ids(got)
    assert all(new[k] == old[k] for k in new.keys() & old.keys()) and len(new.keys() & old.keys()) == 4  # f and g of a.rs, all of b.rs
    assert min(new[k] for k in new.keys() - old.keys()) > max(old.values()) and len({*new.values()}) == len(new)
    assert ingest.summary(got).first().asDict() == {"files": 3, "symbols": 8, "sites": 7, "collisions": 0}
    assert ingest.nam.name_collisions(want["symbol"].select(ingest.F.col("id").alias("symbol"), "name")).isEmpty()


def test_other_facts_of_a_symbol_reach_unchanged_files(spark):
    first = generation(spark, tree(spark, OLD), 1)
    kinds = [("e.rs", "x().", "Macro")]
    built, asked = tree(spark, OLD, kinds), []
    got = generation(spark, built, 2, first, lambda paths: asked.extend(sorted(r["path"] for r in paths.collect())) or built[2].join(paths, "path", "left_semi"))
    want = generation(spark, built, 2)
    assert asked == ["b.rs"]
    assert all(rows_of(got[n], ["site_id"]) == rows_of(want[n], ["site_id"]) for n in NAMES)
    assert [r["ref_kind"] for r in got["call_site"].where(f"declared_target = '{OWN}x().'").collect()] == ["macro"]


def test_ranges_in_utf16(spark):
    """Names behind characters of two and four bytes, one of them of two UTF-16 units; the same sites as by bytes."""
    lines = ["fn a() {", "  /* é\U0001f600 */ f(1);", "  \U0001f600\U0001f600g;", "}"]
    spot = lambda n, name, unit: next(len(lines[n][:i].encode(unit)) // (2 if "16" in unit else 1) for i in range(len(lines[n])) if lines[n].startswith(name, i))
    own = OWN + "a()."

    def index_in(unit):
        found = [("a.rs", 0, 0, own, [0, 3, 4], [0, 0, 3, 1], 1), *[("a.rs", 0, n, OWN + name + "().", [n, spot(n, name, unit), spot(n, name, unit) + 1], None, 0) for n, name in ((1, "f"), (2, "g"))]]
        return spark.createDataFrame([*found, ("a.rs", 0, 9, OWN + "h().", [9, 5, 6], None, 0)], OCC)

    sources = spark.createDataFrame([("a.rs", "\n".join(lines))], "path string, text string")
    info = spark.createDataFrame([("a.rs", 0, 0, own, "Function")], INFO)
    units, raw = index_in("utf-16-le"), index_in("utf-8")
    got = ingest.ranges_in_bytes(units, sources)
    assert got.columns == raw.columns
    full = lambda df: sorted((r["pos"], [r["range"][0], r["range"][1], r["range"][2] if len(r["range"]) == 4 else r["range"][0], r["range"][-1]], r["enclosing_range"]) for r in df.collect())
    assert full(got) == full(raw) != full(units)
    sites = ingest.analyze(got, info, sources)["sites"]
    assert sorted((r["line"], r["ref_kind"]) for r in sites.collect()) == [(2, "call"), (3, "value")]


def test_texts_are_read_by_name(spark, tmp_path):
    from graphloom.sources import readers

    for name, text in (("src/a.rs", "fn é"), ("src/b.rs", "b"), ("c d.rs", "c")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    paths = spark.createDataFrame([("src/a.rs",)], "path string")
    got = readers.source_texts(spark, f"file://{tmp_path}", paths)
    assert [tuple(r) for r in got.collect()] == [("src/a.rs", "fn é")]
    assert [f.rsplit("/", 1)[1] for f in got.inputFiles()] == ["a.rs"]
    assert readers.source_texts(spark, str(tmp_path), paths.limit(0)).count() == 0


def test_occurrences_are_dealt_by_symbol_once_and_by_place_once(spark, monkeypatch):
    """No frame of the analysis shuffles more often than its inputs and those two steps ask for, with nothing broadcast."""
    shuffles, real = [], ingest.checkpointed

    def counted(df):
        shuffles.append(df._jdf.queryExecution().sparkPlan().toString().count("Join") + df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return real(df)

    monkeypatch.setattr(ingest, "checkpointed", counted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sites = ingest.analyze(*index(spark))["sites"]
        assert sites.count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(shuffles) <= 12  # 4 joins and 7 shuffles of all inputs


def test_a_generation_without_carried_facts_can_be_followed(spark):
    """Judged occurrences of a generation that was written before they carried facts of their symbols."""
    from pyspark.sql import functions as F

    occ, info, sources = index(spark)
    files = sources.select("path", F.lit("rust").alias("language"), F.sha2("text", 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size"))
    run = spark.range(1).select(F.lit(1).alias("run_id"))
    first = ingest.generation(occ, info, sources, files, run, "scip@x")
    older = first | {"judged": first["judged"].drop(*ingest.CARRIED)}
    again = ingest.generation(occ, info, sources, files, run, "scip@x", older)
    assert sorted(map(tuple, again["call_site"].collect())) == sorted(map(tuple, first["call_site"].collect()))


def test_plain_symbols_are_split_as_others_are_parsed():
    from graphloom.functions import symbols as sym

    plain = [OUTER, INNER, F_, "s . . . a/b#c:d!e.f(+1).", "s m p v $-_+9#", "locals m p v a."]
    other = [ADD, "local 0", "local x!", "local m p v a.", "s  x m p v a.", "s m p v `a b`.", "s m p v a", "s m p v a(.", "s m p v ", "s m p", "", " m p v a.", "s m p v é.", "s m p v a.(x)", "s m p v a[b]", "s m p v a(é)."]
    for s in plain + other:
        row = sym.parse_symbol(s)
        *fields, error, parts = sym._parsed(s)
        assert dict(zip(sym.FIELDS, fields, strict=True)) == {c: row[c] for c in sym.FIELDS} and error == row["error"], s
        assert [dict(zip(sym.PARTS, x, strict=True)) for x in parts] == row["descriptors"], s
    assert all(sym.PLAIN.fullmatch(s) for s in plain) and not any(sym.PLAIN.fullmatch(s) for s in other)


def test_a_generation_describes_its_symbols_once(spark):
    """Names of symbols are made before they are written, not for each reader of the described symbols."""
    plan = generation(spark, tree(spark, OLD), 1)["symbol"]._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan and "lambda" not in plan
