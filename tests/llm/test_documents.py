"""Operators over documents against brute force, on rows with every odd case."""

import os
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import components, decontamination, jaccard_join, language_id, packing, quality_rules, substring_dedup, token_store, wordhash
from graphloom.llm.shared import new_folder
from graphloom.llm.tokens import default_tokenizer

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return SPACE.findall(t or "")


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


# n-gram Jaccard join
def shingles(t):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def jaccard_components(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=repr)


def test_jaccard_join(docs, rows):
    assert collected(jaccard_join.link(docs)) == jaccard_components(rows)


def families(seed, size, most):
    """Six families of near copies at all distances around the threshold."""
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(6):
        base = [f"w{x}" for x in r.integers(0, 900, 150)]
        for _ in range(size):
            copy = list(base)
            for i in r.choice(150, r.integers(0, most), replace=False):
                copy[i] = f"z{r.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("above", [32, 3])
def test_jaccard_join_of_families(spark, monkeypatch, above):
    """Near copies whose links the first hubs alone don't find; small groups get further hubs, too."""
    monkeypatch.setattr(jaccard_join, "LARGE", above)
    rows = families(5, 12, 9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(jaccard_join.link(df)) == jaccard_components(rows)


@pytest.mark.parametrize("fine_above", [10, 1000])
def test_trees_are_searched_and_lose_no_link(spark, monkeypatch, fine_above):
    """Each document its own component: the cells must give every linked pair, most of them by trees."""
    rows = families(9, 25, 14)
    monkeypatch.setattr(jaccard_join, "FINE_ABOVE", fine_above)
    df = spark.createDataFrame(rows, "id long, text string")
    sets = jaccard_join.classes(df).where("n > 0")
    reps = sets.selectExpr("k1", "id AS rep", "n", "v")
    prefix = jaccard_join.prefixes(df, np.zeros(jaccard_join.SLOTS, np.uint8)).distinct()
    groups = prefix.join(reps, "k1").selectExpr("s AS g", "rep", "rep AS component")
    members = jaccard_join._cells(groups, reps, df).toPandas()
    searched = Counter()
    search = jaccard_join.CountTree.search
    monkeypatch.setattr(jaccard_join.CountTree, "search", lambda self, *a: (searched.update(n=len(a[0])), search(self, *a))[1])
    pairs = {tuple(x) for _, task in members.groupby("task") for x in jaccard_join.cell_pairs(task)[["a", "b"]].to_numpy().tolist()}
    shingled = {i: shingles(t) for i, t in rows}
    linked = {(a, b) for a in shingled for b in shingled if a < b and 100 * len(shingled[a] & shingled[b]) >= 80 * len(shingled[a] | shingled[b])}
    assert linked <= pairs and len(linked) > 100 and searched["n"] > 250
    assert {tuple(r) for r in jaccard_join.verified(spark.createDataFrame(sorted(pairs), "a long, b long"), df).collect()} == linked


def test_count_tree_finds_what_a_scan_finds():
    r = np.random.default_rng(1)
    points = r.poisson(3, (500, 32)).astype(np.int32)
    points[100:140] = points[7] + r.integers(0, 2, (40, 32))
    sizes, comps = points.sum(1), np.arange(500) // 20
    tree = jaccard_join.CountTree(points, sizes, comps)
    asked = np.array([7, 120, 300])
    q, r = tree.search(points[asked], sizes[asked], comps[asked])
    for i, x in enumerate(asked):
        scan = np.flatnonzero((np.minimum(points, points[x]).sum(1) >= jaccard_join.needed(sizes[x], sizes)) & (comps != comps[x]))
        assert sorted(r[q == i]) == scan.tolist()


def test_large_groups_are_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 32 * 8)
    rows = [(1, i, i) for i in range(20)]
    reps = spark.createDataFrame([(i, 128, np.full(32, 4, np.uint8).tobytes()) for i in range(20)], "rep long, n long, v binary")
    members = jaccard_join._cells(spark.createDataFrame(rows, "g long, rep long, component long"), reps, spark.createDataFrame([], "id long, text string")).toPandas()
    assert members["block"].nunique() == 3
    pairs = {tuple(x) for _, task in members.groupby("task") for x in jaccard_join.cell_pairs(task).to_numpy().tolist()}
    assert len(pairs) == 190


def test_points_of_large_counts_bound_nothing():
    v = [np.full(32, 255, np.uint8).tobytes(), np.full(32, 200, np.uint8).tobytes()]
    n = np.array([9000, 32 * 200 + 900])
    assert jaccard_join.bounded_rows(v, n, v[::-1], n[::-1]).tolist() == [False, False]
    assert jaccard_join.bounded_rows(v[:1], np.array([7300]), v[1:], np.array([6400])).tolist() == [True]


def test_keep_one(docs, empty):
    kept = [r["doc_id"] for r in jaccard_join.keep_one(docs).collect()]
    assert kept.count(1) == 3 and 2 not in kept and 3 not in kept and 16 not in kept and kept.count(None) == 2 and {6, 7, 8, 9} <= set(kept)
    assert jaccard_join.link(empty).count() == 0 and jaccard_join.keep_one(empty).columns == empty.columns


def test_components(spark):
    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 340)]
    parent = list(range(400))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        parent[max(p, q)] = min(p, q)
    got = {x["id"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# Substring dedup
def kept_words(rows, window=20):
    unique = sorted({(float("-inf") if r[0] is None else r[0], r[1] or "") for r in rows})
    seen, gone = {}, defaultdict(set)
    for d, t in unique:
        w = words(t)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            if g in seen:
                gone[d, t].update(range(i, i + window))
            seen.setdefault(g, (d, i))
    out = []
    for r in rows:
        w, g = words(r[1]), gone[float("-inf") if r[0] is None else r[0], r[1] or ""]
        kept = [x for i, x in enumerate(w) if i not in g]
        out.append((r[0], len(w), len(w) - len(kept), " ".join(kept)))
    return sorted(out, key=repr)


def test_substring_dedup(docs, rows):
    got = substring_dedup.remove_repeats(docs)
    assert got.columns == [*docs.columns, "n_words", "n_removed", "kept"]
    assert collected(got.select("doc_id", "n_words", "n_removed", "kept")) == kept_words(rows)


def test_substring_dedup_of_repeated_rows(spark):
    """Rows that repeat a document lose no word that occurs in no other document."""
    from tests.llm.conftest import text_of

    shared = text_of(81, 40)
    one, two, other = " ".join(f"w{i}" for i in range(100)), text_of(82, 60) + " " + shared, shared + " " + text_of(83, 60)
    rows = [(1, one), (1, one), (2, two), (3, other), (3, other), (3, other), (3, text_of(84, 50)), (None, text_of(85, 70)), (None, text_of(85, 70)), (4, ""), (4, None), (4, None)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    found = collected(got.select("doc_id", "n_words", "n_removed", "kept"))
    assert found == kept_words(rows) and found.count((1, 100, 0, one)) == 2 and sorted(r[2] for r in found if r[0] == 3) == [0, 40, 40, 40]


def test_substring_dedup_of_hot_passages(spark, monkeypatch):
    """Many different regions with one anchor go window by window."""
    from tests.llm.conftest import text_of

    monkeypatch.setattr(substring_dedup, "HOT_REGIONS", 5)
    shared = text_of(50, 40)
    rows = [(i, text_of(60 + i, i % 30) + " " + shared + " " + text_of(200 + i, 25)) for i in range(30)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert collected(got.select("doc_id", "n_words", "n_removed", "kept")) == kept_words(rows)


def test_substring_dedup_empty(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_suffix_automaton_gives_matching_statistics():
    r = np.random.default_rng(2)
    texts = [[str(x) for x in r.integers(0, 3, n)] for n in (40, 1, 25, 60)]
    automaton = substring_dedup.SuffixAutomaton()
    for k, t in enumerate(texts):
        for e, got in enumerate(automaton.stream(t)):
            best = max((m for m in range(e + 2) if m == 0 or any(u[i : i + m] == t[e + 1 - m : e + 1] for u in texts[:k] for i in range(len(u)))), default=0)
            assert got == best
        automaton.add(t)


def test_word_hashes_find_the_words(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(wordhash, "BLOCK", 16)
    texts = ["a  bc\tdéf", None, "", "x" * 50 + " y", "one two\nthree one", " lead", "trail "]
    h, first, data, s, e = wordhash.word_spans(pa.array(["skip me", *texts])[1:])
    assert [data[a:b].tobytes().decode() for a, b in zip(s, e, strict=True)] == [w for t in texts for w in words(t)]
    assert np.diff(first).tolist() == [len(words(t)) for t in texts]
    assert len(set(h.tolist())) == len({w for t in texts for w in words(t)})


# Benchmark decontamination
def test_decontamination(spark, docs, rows, empty):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    items = [(1, rows[0][1][:200].upper()), (2, rows[0][1][:200]), (10, "one two three"), (11, "one"), (3, None), (4, "..."), (None, "four"), (12, "é" * 5)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, w string")
    want = []
    for r in rows:
        w, hit, found = norm(r[1]), set(), set()
        for i, t in items:
            b = norm(t)
            k = min(len(b), 10)
            grams = {tuple(b[j : j + k]) for j in range(len(b) - k + 1)} if b else set()
            for j in range(len(w) - k + 1) if k else ():
                if tuple(w[j : j + k]) in grams:
                    hit.update(range(j, j + k))
                    found.add(str(i) if i is not None else None)
        want.append((r[0], len(w), len(hit), sorted(x for x in found if x is not None)))
    got = decontamination.find_hits(docs, bench)
    assert collected(got.select("doc_id", "n_words", decontamination.hit_words(F.col("spans")), "items")) == sorted(want, key=repr)
    hit = {w[0] for w in want if w[2]}
    clean = decontamination.remove_hits(docs, bench)
    assert clean.columns == docs.columns and not hit & {r["doc_id"] for r in clean.where("doc_id is not null").collect()}
    assert clean.count() == sum(not w[2] for w in want)
    cut = decontamination.remove_hits(docs, bench, mode="spans")
    assert cut.count() == len(rows) and cut.where("doc_id = 9").first()["text"] == ""
    assert decontamination.find_hits(empty, bench).count() == 0
    assert decontamination.find_hits(docs, bench.limit(0)).where("size(spans) > 0").count() == 0


def test_decontamination_by_shuffle(spark, docs, empty, monkeypatch):
    """Beyond the broadcast bound: equal results, and no word array in the shuffle of windows."""
    bench = spark.createDataFrame([(1, text_part(docs, 1, 20, 45)), (2, text_part(docs, 4, 60, 75)), (3, "one"), (None, text_part(docs, 1, 30, 41)), (5, None)], "item_id long, text string")
    want = collected(decontamination.find_hits(docs, bench))
    assert sum(bool(x[3]) for x in want) > 4
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    got = decontamination.find_hits(docs, bench)
    assert collected(got) == want and decontamination.find_hits(empty, bench).count() == 0
    assert collected(decontamination.find_hits(docs, bench.limit(0))) == [(*x[:3], [], []) for x in want]


def text_part(docs, doc_id, a, b):
    return " ".join(docs.where(F.col("doc_id") == doc_id).first()["text"].split()[a:b])


# Quality rules
def test_host_verdicts_reach_the_documents(spark):
    """Failing hosts lose what fails a rule, others only what fails the base rules; small hosts are pulled to the mean."""
    good, symbols = " ".join(f"word{i}" for i in range(60)), " ".join(f"word{i}#######" for i in range(60))
    rows, n = [], 0
    for host, bad, all_ in [("bad", 28, 40), *[(f"fine{i}", 1, 40) for i in range(30)], ("small", 1, 1), *[(f"one{i}", 0, 1) for i in range(9)]]:
        for i in range(all_):
            rows.append((n, symbols if i < bad else good, f"https://{host}/x"))
            n += 1
    rows.append((n, "too short", "https://fine0/y"))
    got = {r["doc_id"]: r for r in quality_rules.apply_host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    want = {d: t == good or (t == symbols and "//bad/" not in s) for d, t, s in rows}
    assert {d: r["kept"] for d, r in got.items()} == want and sum(not x for x in want.values()) == 29


def test_hosts_of_one_document_show_no_spread(spark):
    rows = [(f"h{i}", i % 5 == 0) for i in range(1000)]
    got = quality_rules.host_verdicts(spark.createDataFrame(rows, "host string, rule_failed boolean"))
    assert got.where("host_failed").isEmpty() and got.count() == 1000


def test_quality_rules(docs, rows, empty):
    want = []
    for r in rows:
        t = r[1] or ""
        w, lines = words(t), [x for x in t.split("\n") if words(x)]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in range(i, i + 3)}
        want.append((r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)))
    got = quality_rules.apply_host_rules(docs)
    assert collected(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == sorted(want, key=repr)
    assert not got.where("kept AND base_failed").count() and quality_rules.apply_host_rules(empty).count() == 0


def test_long_documents_take_the_exact_path(docs, monkeypatch):
    want = collected(quality_rules.document_features(docs))
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 5)
    assert collected(quality_rules.document_features(docs)) == want


def test_host_rates_are_shrunk(spark):
    rows = [("good", False)] * 50 + [("bad", True)] * 45 + [("bad", False)] * 5 + [("tiny", True)] + [(f"h{i}", i == 0) for i in range(30)]
    got = {r["host"]: r for r in quality_rules.host_verdicts(spark.createDataFrame(rows, "host string, rule_failed boolean")).collect()}
    assert got["bad"]["host_failed"] and not got["good"]["host_failed"] and got["tiny"]["rate"] < 1


# Packing and token store
@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return lambda text, end: np.array([*(t.encode(text, add_special_tokens=False).ids if text else []), end], "<u4")


def check_pieces(pieces, rows, encode):
    ids = Counter((r[0], encode(r[1], 1).tobytes()) for r in rows)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
        by_seq[p["sequence_id"]].append(p)
        assert len(p["ids"]) == 4 * p["length"] > 0
    assert sum(p["length"] for p in pieces) == sum(len(k[1]) // 4 * n for k, n in ids.items())
    for (doc, total), found in by_doc.items():
        starts = sorted((p["start"], p["length"], bytes(p["ids"])) for p in found)
        texts = [raw for d, raw in ids if d == doc and len(raw) == 4 * total]
        assert all(any(raw[4 * s : 4 * (s + n)] == x for raw in texts) for s, n, x in starts)
    for found in by_seq.values():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 2048 or at & (at - 1) == 0


def test_packing(docs, rows, empty, encode):
    check_pieces(packing.pack(docs).collect(), rows, encode)
    check_pieces(packing.pack(docs, max_open=2).collect(), rows, encode)
    check_pieces(packing.pack(docs, stream_pieces=2).collect(), rows, encode)
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("sizes", [(10, 10), (1100, 1300), (1, 2047)])
def test_packing_in_rounds(spark, encode, sizes):
    """Streams of few windows each, where all, none or most fit; whatever the sizes, padding is none."""
    r = np.random.default_rng(8)
    rows = [(i, "a " * int(r.integers(sizes[0], sizes[1] + 1) - 1)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    check_pieces(packing.pack(docs, stream_pieces=20).collect(), rows, encode)


def test_most_windows_are_placed_by_sum_of_squares(spark):
    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.isfile(path):
        pytest.skip("no test tables here")
    pieces = packing.pack(spark.read.parquet(path).repartition(8))
    how = {r["how"]: r["n"] for r in pieces.groupBy("how").agg(F.countDistinct("sequence_id").alias("n")).collect()}
    assert how["placed"] > 4 * how["joined"]


def test_sum_of_squares_takes_the_best_level():
    r = np.random.default_rng(4)
    p = packing.SumOfSquares(64, 10**6)
    for i in range(3000):
        size = int(r.integers(1, 64))
        level = p.level_for(size)

        def after(h, size=size):
            n = p.counts.copy()
            n[h] -= h > 0
            n[h + size] += h + size < 64
            return int((n[1:64] ** 2).sum())

        options = [h for h in range(65 - size) if h == 0 or p.counts[h] > 0]
        assert after(level) == min(map(after, options)) and level == max(h for h in options if after(h) == after(level))
        p.place((i, 0, size, b"\0\0\0\0" * size, size))


def test_token_store(spark, docs, rows, empty, encode):
    store = token_store.write_store(docs, new_folder(spark, "store"))
    got = store.read(token_store.document_keys(docs)).collect()
    order = sorted(((r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "") for r in rows))
    at, want = 0, []
    for has, d, has_text, t in order:
        ids = encode(t if has_text else None, 2)
        want.append((d if has else None, at, len(ids), ids.tobytes()))
        at += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) for r in got), key=repr) == sorted(want, key=repr)
    absent = spark.createDataFrame([(10**9 + i, 0) for i in range(50)], "doc_id long, nth int")
    assert store.read(absent).count() == 0
    none = token_store.write_store(empty, new_folder(spark, "store"))
    assert none.read(token_store.document_keys(docs)).count() == 0


def test_perfect_hash_is_minimal_and_round_trips():
    keys = np.unique(np.random.default_rng(6).integers(0, 1 << 63, 5000, dtype=np.uint64))
    ph, _ = token_store.PerfectHash.from_bytes(token_store.PerfectHash.build(keys).to_bytes())
    assert sorted(ph.slot_of(keys)) == list(range(len(keys)))


def test_end_id_must_fit_the_separator(spark, docs):
    with pytest.raises(ValueError):
        token_store.write_store(docs, new_folder(spark, "store"), end_id=200)


def test_token_store_reads_the_parts_it_needs(spark, docs, monkeypatch):
    monkeypatch.setattr(token_store, "PART_KEYS", 2)
    monkeypatch.setattr(token_store, "WHOLE_INDEX_PARTS", 1)
    monkeypatch.setattr(token_store, "SHARD_BYTES", 200)
    store = token_store.write_store(docs, new_folder(spark, "store"))
    assert store.n_parts > 3 and len(store.paths) > 4  # more shards than shuffle partitions
    keys = token_store.document_keys(docs)
    one = keys.limit(1)
    plan = store.locate(one)._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^]]*(EqualTo\(part|In\(part)", plan)
    assert [tuple(r) for r in store.read(one).select("doc_id", "nth").collect()] == [tuple(one.first())]
    got, want = ({(r["doc_id"], r["nth"]): (r["start"], bytes(r["ids"])) for r in s.read(keys).collect()} for s in (store, token_store.write_store(docs, new_folder(spark, "store"), n_shards=3)))
    assert got == want and len(got) == keys.count()


def test_token_store_refuses_equal_hashes():
    two = np.array([5, 5], np.uint64)
    with pytest.raises(ValueError, match="same 64-bit hash"):
        token_store.build_part(two, np.array([1, 2], np.uint32), [0, 0], [0, 1], [1, 1])


# Language ID
def test_language_id(spark, docs, rows, empty):
    r = np.random.default_rng(7)
    parts = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ein", "ung", "er"], "cc": ["eau", "oi", "que", "è"]}
    data = [(i, " ".join("".join(r.choice(parts[k], 3)) for _ in range(r.integers(1, 80))), k, i) for i in range(600) for k in [["aa", "bb", "cc"][i % 3]]]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, score long")
    model = language_id.fit(df.where(~language_id.held_out(F.col("doc_id"))), sample_per_language=60)
    got = language_id.identify(df, model)
    test = got.where(language_id.held_out(F.col("doc_id")))
    assert test.where("lang = lang_pred").count() > 0.97 * test.count() and got.where("rejected").count() < 3
    odd = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert odd[7]["lang_pred"] == odd[6]["lang_pred"] == odd[15]["lang_pred"] == "und" and odd[7]["rejected"] and odd[7]["score"] == 0
    none = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.identify(docs, none).collect()} == {"und"} and language_id.identify(empty, none).count() == 0


def test_language_id_rejects_junk_and_unlearned_languages(spark):
    import base64
    import random

    r = random.Random(9)
    lexicon = {"aa": "the of and to in is that for on with as by this be at from or an are it was not which their has", "bb": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden", "cc": "le la les de des et en un une que est pour qui dans par plus pas au sur ne se ce il sont avec été"}
    stems = {k: [w + x for w in v.split() for x in ("", *v.split()[:6])] for k, v in lexicon.items()}
    data = [(i, " ".join(r.choice(stems[k]) for _ in range(r.choice([8, 40, 300]))), k) for i in range(900) for k in [["aa", "bb", "cc"][i % 3]]]
    data += [(1000 + i, f"{w} " * 200, "aa") for i, w in enumerate(["zq", "xj", "vv"])]  # outliers that must not take centroids
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language_id.fit(df.where(~language_id.held_out(F.col("doc_id"))))
    clean = language_id.identify(df.where(language_id.held_out(F.col("doc_id")) & (F.col("doc_id") < 1000)), model)
    assert clean.where("NOT rejected AND lang = lang_pred").count() >= 0.98 * clean.count()
    polish, russian = "szczęście źródło które przez wszystko jest nie będzie można także więc jednak właśnie".split(), "это что как для все они было быть время человек который только можно".split()
    junk = [
        base64.b64encode(r.randbytes(2250)).decode(),
        " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(r.randint(3, 9))) for _ in range(300)),
        "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(3000)),
        " ".join(r.choice(polish) for _ in range(400)),
        " ".join(r.choice(russian) for _ in range(300)),
        "这是一段没有学过的文字", "это время человек который только",
    ]
    got = language_id.identify(spark.createDataFrame(list(enumerate(junk)), "doc_id long, text string"), model).collect()
    assert [x["doc_id"] for x in got if not x["rejected"]] == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_language_id_rejects_long_junk_beside_the_given_tables(spark):
    import base64
    import random

    r = random.Random(1)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~held))
    junk = [base64.b64encode(r.randbytes(2250)).decode(), " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(r.randint(3, 9))) for _ in range(300)), "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(3000))]
    assert all(model.predict(x)[2] for x in junk)
    clean = language_id.identify(docs.where(held & F.col("text").rlike(r"\p{L}")), model)
    assert clean.where("NOT rejected AND lang = lang_pred").count() >= 0.98 * clean.count() > 0


def test_kmeans_spends_no_centroid_on_an_outlier():
    r = np.random.default_rng(8)
    x = np.abs(np.concatenate([m + r.normal(0, 0.1, (50, 32)) for m in np.eye(32)[:2]] + [np.eye(32)[20:23]]))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    near = (x @ language_id.spherical_kmeans(x, 4).T).argmax(1)
    assert np.bincount(near).min() >= 2 and not set(near[:50]) & set(near[50:100])


def test_held_out_is_by_crc(spark):
    got = spark.range(50).select("id", language_id.held_out(F.col("id")).alias("x")).collect()
    assert all(r["x"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


def test_kept_sha_of_nothing(docs):
    got = substring_dedup.remove_repeats(docs).where("doc_id = 6").select(F.sha2("kept", 256)).first()[0]
    assert got == sha256(b"").hexdigest()


def grams_by_hand(text):
    """How often each hashed n-gram of a text occurs, byte by byte."""
    mask, out = 2**32 - 1, np.zeros(language_id.DIMS)
    raw = [x if x >= 128 or 97 <= x <= 122 else 32 for x in text.lower().encode()]
    b = [32]
    for x in [*raw, 32]:
        if x != 32 or b[-1] != 32:
            b.append(x)
    for i in range(len(b)):
        two = (b[i] * 0x9E3779B1 + b[i + 1] * 0x85EBCA77) & mask if i + 1 < len(b) else None
        for h in (b[i] * 0x27D4EB2F & mask, two, (two + b[i + 2] * 0xC2B2AE3D) & mask if i + 2 < len(b) else None):
            if h is not None:
                out[((h ^ h >> 15) * 0x2C1B3C6D & mask) >> 20] += 1
    return out


def test_language_id_against_plain_numpy(spark):
    """Document frequencies, centroids, radii and verdicts of the smallest table, each text taken by itself."""
    from zlib import crc32

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.isfile(path):
        pytest.skip("no test tables here")
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(path).select("doc_id", "text", "lang").collect()]
    held = lambda d: crc32(str(d).encode()) % 5 == 0
    learn = [(t, lang) for d, t, lang in docs if not held(d) and lang is not None]
    letter = lambda t: bool(t) and any(c.isalpha() for c in t)
    tf = {t: grams_by_hand(t) for _, t, _ in docs if t}
    n, df = sum(1 for t, _ in learn if t), sum((tf[t] > 0).astype(int) for t, _ in learn if t)
    idf = np.log((1 + n) / (1 + df)) + 1
    unit = lambda v: np.log1p(v) * idf / max(np.linalg.norm(np.log1p(v) * idf), 1e-12)
    band = lambda v: min(int(np.log2(max(v.sum(), 1))) // 2, language_id.BANDS - 1)
    centroids, radius = {}, {}
    for lang in sorted({lang for _, lang in learn}):
        x = [unit(tf[t]) for t, own in learn if own == lang and letter(t)]
        order = sorted(range(len(x)), key=lambda i: x[i].astype(np.float32).tobytes())
        x = np.stack([x[i] for i in order])
        c = language_id.spherical_kmeans(x.astype(np.float32), language_id.CENTROIDS).astype(float)
        near = (x @ c.T).argmax(1)
        for j in range(len(c)):  # each is the mean of those nearest to it, or was before a last small step
            mean = x[near == j].mean(0)
            assert c[j] @ mean / np.linalg.norm(mean) > 0.98
        cos, bands = [], []
        for t, own in learn:
            if own == lang and letter(t):
                starts = [(crc32(t[:64].encode()) % (len(t) - k), k) for k in language_id.PIECES if k < len(t)]
                for part in [t, *[t[a : a + k] for a, k in starts if letter(t[a : a + k])]]:
                    v = grams_by_hand(part)
                    cos.append(max(c @ unit(v)))
                    bands.append(band(v))
        centroids[lang], radius[lang] = c, language_id.radii(np.array(cos), np.array(bands))
    want = {}
    for d, t, _ in docs:
        if not letter(t):
            want[d] = ("und", 0.0, True)
            continue
        score, lang = max((max(c @ unit(tf[t])), lang) for lang, c in centroids.items())
        want[d] = (lang, min(max(score, 0.0), 1.0), score < radius[lang][band(tf[t])])
    model = language_id.fit(spark.read.parquet(path).where(~language_id.held_out(F.col("doc_id"))))
    assert np.allclose(model.idf, idf) and model.languages == [lang for lang, c in centroids.items() for _ in c]
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["rejected"]) for r in language_id.identify(spark.read.parquet(path), model).collect()}
    assert got.keys() == want.keys() and all(got[d][::2] == want[d][::2] and got[d][1] == pytest.approx(want[d][1], abs=1e-5) for d in want)
    query = {r["doc_id"]: r for r in language_id.op3_language_id(spark, "/root/testdata/sf0.001").collect()}
    assert all((query[d]["lang_pred"], query[d]["held_out"]) == (want[d][0], held(d)) for d in want)
