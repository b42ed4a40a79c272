"""The prefix trie against every prefix of every conversation, and against its SQL."""

import os
import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from graphloom.llm import prefix_trie

TURN = "conv_id long, turn long, role string, text string, depth long, a string, i string"


def by_hand(rows):
    """The nodes of (conv_id, turn, role, text), from lists of whole prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = own.get(first, [])[:h] + ts[h:]
    members = defaultdict(set)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].add(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, cs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(cs) - 1) * len(node[-1][1].split() if node else [])
    out = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(built[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), children[node], leaves[node], saved[node], sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes_of(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x", None) for r in rows], TURN).repartition(3)
    return sorted(map(tuple, prefix_trie.prefix_trie(*prefix_trie.rebuild(df), **options).collect()), key=repr)


@pytest.mark.parametrize("cells", [prefix_trie.CELLS, 64])
def test_every_prefix(spark, cells, monkeypatch):
    """Shared heads, copies, turnless conversations, nulls, ties and repeated rows; also where the sketch says nothing."""
    r = random.Random(3)
    rows = []
    for c in [*range(90), -5, -25, 1_000, 1_007, 10**15]:
        for t in range(r.choice([1, 2, 2, 3, 5, 8])):
            rows.append((c, r.choice([t, t, None, 0]), r.choice(["user", "bot", None]), r.choice(["hi", "a b", "a b c", "", None, f"own {c}"])))
    copy = [("user", "same words here"), ("bot", "more words"), (None, None)]
    rows += [(c, t, *copy[t]) for c in range(200, 320) for t in range(3)] + [(250, 3, "user", "goes on")]
    rows += [rows[0], rows[0], (None, 0, "user", "nobody's"), (201, None, None, None), (400, 2**40, "u", "x"), (400, -(2**40), "u", "y")]
    monkeypatch.setattr(prefix_trie, "ENDS", 7)
    assert nodes_of(spark, rows, cells=cells) == by_hand(rows)


def test_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    rows = [(c, t, "u", f"turn {t if t < cut else (c, t)}") for c, cut in ((0, 70), (20, 70), (21, 40), (40, 10)) for t in range(80)]
    rows += [(60, None, "u", str(t)) for t in range(30)]
    assert nodes_of(spark, rows) == by_hand(rows)


def test_nothing_and_one(spark):
    assert nodes_of(spark, []) == []
    assert nodes_of(spark, [(None, 1, "u", "x")]) == []
    assert nodes_of(spark, [(3, 0, "u", "x y")]) == by_hand([(3, 0, "u", "x y")])


def test_tails_are_not_grouped(spark):
    """The sketch proves that conversations without a common turn share the root alone."""
    rows = [(c * 20, t, "u", f"{c} {t}") for c in range(300) for t in range(4)]
    df = spark.createDataFrame([(*r, 1, "x", None) for r in rows], TURN)
    convs, turns = prefix_trie.rebuild(df)
    singles = prefix_trie.first_singletons(prefix_trie.prefixes(convs, turns)).collect()
    assert len(singles) == 300 and sum(r["single"] > 1 for r in singles) < 10


def test_query_equals_its_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
    df = prefix_trie.op11_prefix_trie(spark, path)
    want = c.execute(f"SELECT {', '.join(df.columns)} FROM ({prefix_trie.ORACLE_SQL})").fetchall()
    got = sorted(map(tuple, df.collect()), key=repr)
    assert got == sorted(map(tuple, want), key=repr) == by_hand([tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
