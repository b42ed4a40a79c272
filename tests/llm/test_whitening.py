"""Whitening against NumPy's eigenvectors of the exact covariance, and its solver against singular values."""

import math
import os

import numpy as np
import pytest

from graphloom.llm import whitening

VECTOR = "vec_id long, embedding array<float>, label int, vec string, component int, n string"


def by_hand(rows, most=32):
    """{vec_id: [(component, n, deviation, |whitened|, explained)]} of (vec_id, vector); ids are unique."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good]
    n, d = len(x), len(x[0])
    sums = [sum(row[j] for row in x) for j in range(d)]
    off = np.array([[(n * row[j] - sums[j]) / n for j in range(d)] for row in x])
    cov = off.T @ off / n
    e, vectors = np.linalg.eigh(cov)
    e, vectors = e[::-1], vectors[:, ::-1]
    k = min(most, int((e > 1e-12 * e[0]).sum()))
    y = off @ vectors[:, :k] / np.sqrt(e[:k])
    deviations = [sum((n * row[j] - sums[j]) ** 2 for j in range(d)) for row in x]
    return {i: [(c + 1, n, deviations[r], abs(y[r, c]), e[c] / np.trace(cov)) for c in range(k)] for r, (i, _) in enumerate(good)}


def same(df, want):
    got, signs = {}, {}
    rows = df.collect()
    for r in sorted(rows, key=lambda r: (r["component"], r["vec_id"])):
        got.setdefault(r["vec_id"], []).append(r)
    assert got.keys() == want.keys()
    for i, components in want.items():
        assert [(r["component"], r["n"], r["deviation"]) for r in got[i]] == [c[:3] for c in components]
        for r, (c, _, _, y, explained) in zip(got[i], components, strict=True):
            assert abs(r["whitened"]) == pytest.approx(y, abs=1e-8) and r["explained"] == pytest.approx(explained, rel=1e-9)
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9


def vectors(n, d, seed=1):
    r = np.random.default_rng(seed)
    return [[float(np.float32(c)) for c in v] for v in r.standard_normal((n, d)) * np.linspace(3, 0.5, d)]


def test_whitened_rows(spark):
    rows = list(enumerate(vectors(700, 40)))
    bad = [None, [1.0, None] + [0.0] * 38, [float("nan")] + [0.0] * 39, [float("inf")] * 40, [float("-inf")] + [1.0] * 39, [], [1.0] * 39]
    rows += [(1000 + i, rows[5][1]) for i in range(300)]  # a very common vector
    df = spark.createDataFrame([(i, v, 1, "x", 2, "y") for i, v in rows] + [(5000 + i, v, 1, "x", 2, "y") for i, v in enumerate(bad)], VECTOR).repartition(5)
    same(whitening.whiten(df), by_hand(rows))
    assert all(np.isclose(np.std([r["whitened"] for r in whitening.whiten(df).where(f"component = {c}").collect()]), 1) for c in (1, 32))


def test_triangles_are_folded(spark):
    df = whitening.usable(spark.createDataFrame(list(enumerate(vectors(500, 12))), "vec_id long, embedding array<double>").repartition(16), "embedding")
    sums = whitening.sums_of(df)
    x = np.concatenate([whitening.numbers(b) for b in df.select("vec").toArrow().to_batches()])
    c = sums.centred(x)
    r = whitening.triangle(df, sums, fan_in=3)
    assert r.shape == (12, 12) and np.allclose(r.T @ r, c.T @ c, rtol=1e-12)


def test_few_dimensions_rows_and_ranks(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 1, "x", 2, "y") for i, v in rows], VECTOR)
    same(whitening.whiten(make(list(enumerate(vectors(50, 3))))), by_hand(list(enumerate(vectors(50, 3)))))
    flat = [(i, [v[0], 1.5, 2.0 * v[0], v[1]]) for i, v in enumerate([[float(round(c * 8)) for c in v] for v in vectors(60, 2)])]
    assert max(len(c) for c in by_hand(flat).values()) == 2  # one constant dimension and one that another tells
    same(whitening.whiten(make(flat)), by_hand(flat))
    wide = list(enumerate(vectors(5, 9)))
    assert whitening.whiten(make(wide)).count() == 5 * 4
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 1.0])], [(1, [0.5]), (2, [0.5]), (None, [0.5])]):
        assert whitening.whiten(make(rows)).collect() == []
    got = whitening.whiten(make([(None, [0.0, 1.0]), (None, [0.0, 1.0]), (1, [8.0, 1.0]), (1, [1.0, 2.0, 3.0])])).collect()
    assert sorted((r["vec_id"] or 0, r["n"], r["deviation"]) for r in got) == [(0, 3, 512**2), (0, 3, 512**2), (1, 3, 1024**2)]


def test_huge_entries(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 5.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in got} == {None} | {r["deviation"] for r in got if r["vec_id"] == 3}
    assert all(math.isfinite(r["whitened"]) for r in got)


@pytest.mark.parametrize("name", ["plain", "graded", "rank", "equal", "blocks", "wilkinson", "tight", "zero", "one"])
def test_solver(name):
    r = np.random.default_rng(0)
    basis = np.linalg.qr(r.standard_normal((40, 40)))[0]
    a = {
        "plain": r.standard_normal((300, 40)), "graded": r.standard_normal((300, 40)) * np.logspace(0, -9, 40), "rank": r.standard_normal((300, 40)) * np.r_[np.ones(20), np.zeros(20)], "equal": np.eye(40) * 3,
        "blocks": np.vstack([np.eye(40)] * 2 + [r.standard_normal((3, 40))]), "wilkinson": np.diag(np.abs(np.arange(-10, 11)) + 1.0) + np.diag(np.ones(20), 1), "tight": basis @ np.diag(np.r_[np.full(20, 2.0), np.full(10, 2 * (1 + 1e-9)), np.full(10, 1e-3)]) @ basis.T,
        "zero": np.zeros((50, 8)), "one": r.standard_normal((50, 1)),
    }[name]
    q, e, w = whitening.bidiagonal(np.linalg.qr(a, mode="r"))
    values, found = whitening.directions(q, e, 64)
    vectors, want = w @ found, np.linalg.svd(a, compute_uv=False)
    k = len(values)
    assert k == (want > 1e-12 * max(want[0], 1e-300)).sum()
    if k:
        assert np.allclose(np.sqrt(values), want[:k], rtol=1e-6 if name == "graded" else 1e-12)
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-11
        assert np.abs(a.T @ (a @ vectors) - vectors * values).max() < (1e-8 if name == "tight" else 1e-12) * values[0]


def test_dqds_keeps_small_values():
    """Values of a graded bidiagonal matrix to high relative accuracy, against ratios of whole numbers."""
    from fractions import Fraction

    q, e = np.array([1.0, 1e-5, 1e-10, 1e-15]), np.array([0.5, 1e-6, 1e-11])
    got = whitening.dqds(q * q, e * e)
    assert np.prod(got / (q * q)[[0, 1, 2, 3]]) == pytest.approx(1, rel=1e-13)  # the determinant
    q2, e2 = [Fraction(x) ** 2 for x in q.tolist()], [Fraction(x) ** 2 for x in e.tolist()]
    inverse, d = Fraction(0), q2[0]
    for i in range(4):  # the trace of the inverse: the smallest value rules it
        inverse += 1 / d
        d = d * q2[i + 1] / (d + e2[i]) if i < 3 else d
    assert sum(1 / v for v in got) == pytest.approx(float(inverse), rel=1e-12)


def test_query(spark):
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    same(whitening.op13_whitening(spark, path), by_hand(rows))
