"""Whitening of embeddings by singular values of their centred rows.

Vectors become whole numbers. Their sums are exact, so rows are centred before anything is multiplied: each task folds
its rows, block by block, into one upper triangle by QR, and triangles are folded by the thousand until one is left. No
covariance is formed. The triangle, d by d, is made bidiagonal by Householder reflections on the driver; dqds finds its
singular values to high relative accuracy, and a twisted factorisation per value gives its right vector, which the
reflections carry back to the space of the embeddings.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped, and so are rows without the
commonest length (the longest at ties), whose other entries count as missing; an entry whose number is beyond 2 ** 53
stands at 2 ** 53. Components are those of singular values that tell from rounding, at most `most`, so fewer than that
where vectors span less; nothing is returned where all vectors are equal or there are none. deviation is null where it is
beyond a long. Repeated rows (and null vec_ids) are whitened one by one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import staged, unstaged

SCALE, OFFSET, LIMIT = 64, 1_000_000, 2.0**53
#: Rows of a block that QR takes at once, and triangles that one task folds.
BLOCK_ROWS, FAN_IN = 8192, 1024
EPS = np.finfo(float).eps
#: Singular values below this part of the largest don't tell from rounding.
RANK = 1e-12


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """vec_id and vec (array of doubles), without rows that aren't whole vectors of the commonest length."""
    vec = F.col(column).cast("array<double>")
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select("vec_id", vec.alias("vec")).where(whole & (F.size(vec) > 0))
    width = rows.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).first()
    return rows.where(F.size("vec") == (width["width"] if width else 0))


def numbers(batch) -> np.ndarray:
    """The batch's vectors as whole numbers (int64), a row each."""
    flat = batch["vec"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
    return np.clip(np.floor(SCALE * flat) + OFFSET, -LIMIT, LIMIT).astype(np.int64)


class Sums:
    """n and each dimension's exact sum, as whole numbers of any size."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.floor = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], object)  # sum = n * floor + rest
        self.part = np.array([(s % n) / n for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor) - self.part

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - sum) ** 2 over the dimensions, exactly; null where it is beyond a long."""
        off = x - self.floor
        if self.n * (int(np.abs(off).max(initial=0)) + 1) < 2**31 / len(self.sums):
            return ((self.n * off - self.rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        total = ((self.n * off.astype(object) - self.rest) ** 2).sum(axis=1)
        return [int(t) if t < 2**63 else None for t in total]


def sums_of(rows: DataFrame) -> Sums | None:
    def run(batches):
        import pyarrow as pa

        high, low, n = 0, 0, 0
        for batch in batches:
            if len(batch):
                x = numbers(batch)
                high, low, n = high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high))), pa.array(high), pa.array(low), pa.array([n] * len(high))], ["dimension", "high", "low", "n"])

    parts = rows.select("vec").mapInArrow(run, "dimension long, high long, low long, n long")
    whole = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low", "n")]
    found = parts.groupBy("dimension").agg(*whole).orderBy("dimension").collect()  # a row per dimension
    return Sums(int(found[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in found]) if found else None


def triangle(rows: DataFrame, sums: Sums, fan_in: int = FAN_IN) -> np.ndarray:
    """R of the QR factorisation of all centred rows."""
    d = len(sums.sums)

    def stack(blocks):
        r = np.zeros((0, d))
        for block in blocks:
            r = np.linalg.qr(np.vstack([r, block]), mode="r")
        return r

    def out(r, number: int):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([r.tobytes()])], ["number", "r"])

    def fold_rows(batches):
        from pyspark import TaskContext

        blocks = (sums.centred(numbers(part)) for batch in batches for at in range(0, len(batch), BLOCK_ROWS) for part in [batch.slice(at, BLOCK_ROWS)])
        if len(r := stack(blocks)):
            yield out(r, TaskContext.get().partitionId())

    def fold_triangles(batches):
        at, r = None, None
        for batch in batches:
            for number, raw in zip(batch["number"].to_pylist(), batch["r"].to_pylist(), strict=True):
                if number != at:
                    if at is not None:
                        yield out(r, at)
                    at, r = number, np.zeros((0, d))
                r = stack([r, np.frombuffer(raw).reshape(-1, d)]) if len(r) else np.frombuffer(raw).reshape(-1, d)
        if at is not None:
            yield out(r, at)

    schema = "number long, r binary"
    parts = staged(rows.select("vec").mapInArrow(fold_rows, schema), "triangles")
    while parts.count() > 1:
        last = parts
        parts = staged(last.withColumn("number", F.expr(f"number div {fan_in}")).repartition("number").sortWithinPartitions("number").mapInArrow(fold_triangles, schema), "triangles")
        unstaged(last)
    return np.frombuffer(parts.first()["r"]).reshape(-1, d)


def reflect(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(v, t, b): (1 - t v v') x is b times the first unit vector."""
    v, tail = x.copy(), float(np.linalg.norm(x[1:]))
    if tail == 0.0:
        return v, 0.0, float(x[0])
    norm = float(np.hypot(x[0], tail))
    b = -norm if x[0] > 0 else norm
    v[0] -= b
    v /= np.abs(v).max()
    return v, 2.0 / float(v @ v), b


def bidiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, e, w): a = u b w' for orthogonal u and w, and b with diagonal q and e above it."""
    a, n = a.copy(), a.shape[1]
    w, q, e = np.eye(n), np.zeros(n), np.zeros(max(n - 1, 0))
    for k in range(n):
        v, t, q[k] = reflect(a[k:, k])
        a[k:, k:] -= np.outer(t * v, v @ a[k:, k:])
        if k < n - 1:
            v, t, e[k] = reflect(a[k, k + 1 :])
            a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ v, t * v)
            w[:, k + 1 :] -= np.outer(w[:, k + 1 :] @ v, t * v)
    return q, e, w


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix from the squares of its entries, falling. Each sweep is a
    differential quotient-difference step with a shift below the least value; a step that turns negative is done anew
    with a smaller shift, at last with none, which always holds."""
    done: list[float] = []
    todo = [(q.copy(), np.append(e, 0.0), 0.0)]
    while todo:
        q, e, shifted = todo.pop()
        tries = 0.25
        while len(q):
            n = len(q)
            if n == 1 or e[n - 2] <= EPS * EPS * max(shifted, q[n - 1]):
                done.append(q[n - 1] + shifted)
                q, e = q[: n - 1], e[: n - 1]
                continue
            small = np.flatnonzero(e[: n - 1] <= EPS * EPS * (shifted + np.minimum(q[:-1], q[1:])))
            if len(small):
                cut = int(small[-1]) + 1
                todo.append((q[:cut].copy(), e[:cut].copy(), shifted))
                q, e = q[cut:], e[cut:]
                continue
            if q[0] < q[n - 1]:  # values come out of the small end
                q, e = q[::-1].copy(), np.append(e[n - 2 :: -1], 0.0)
            shift = tries * least_value(q, e)
            while True:
                q2, e2, low = sweep(q, e, shift)
                if low >= 0.0 or shift == 0.0:
                    break
                shift = shift / 4 if shift > EPS * q.min() else 0.0
                tries = 0.25
            tries = min(0.999, (1 + 3 * tries) / 4) if shift else 0.25
            q, e, shifted = np.maximum(q2, 0.0), e2, shifted + shift
    return np.sort(done)[::-1]


def least_value(q: np.ndarray, e: np.ndarray) -> float:
    """A lower bound of the least squared singular value: one over the trace of the inverse, by the sums of a sweep
    without shift."""
    d, total = q[0], 0.0
    for i in range(len(q) - 1):
        if d <= 0.0:
            return 0.0
        total += 1.0 / d
        d = d * (q[i + 1] / (d + e[i]))
    return 1.0 / (total + 1.0 / d) if d > 0.0 else 0.0


def sweep(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    q2, e2, d = np.empty_like(q), np.zeros_like(e), q[0] - shift
    low = d
    for i in range(len(q) - 1):
        q2[i] = d + e[i]
        ratio = q[i + 1] / q2[i] if q2[i] > 0.0 else 0.0
        e2[i] = e[i] * ratio
        d = d * ratio - shift
        low = min(low, d)
    q2[-1] = d
    return q2, e2, low


def twisted(q: np.ndarray, e: np.ndarray, value: float) -> np.ndarray:
    """The unit right singular vector of an unreduced bidiagonal matrix (diagonal q, e above it) for a squared singular
    value, by the factorisations of b'b - value from both ends, joined where their residual is least."""
    n, tiny = len(q), EPS * EPS * max(float(np.max(q * q)), value, np.finfo(float).tiny)
    q2, e2 = q * q, np.append(e * e, 0.0)
    # b'b = l d l' with pivots q2 and couplings q * e. From above: pivots s + q2; from below: pivots p + e2 (of the row above).
    s, up = np.empty(n), np.empty(max(n - 1, 0))
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + q2[i]
        pivot = pivot if abs(pivot) > tiny else -tiny
        up[i] = q[i] * e[i] / pivot
        s[i + 1] = e2[i] * (s[i] / pivot) - value
    p, down = np.empty(n), np.empty(max(n - 1, 0))
    p[-1] = q2[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = e2[i] + p[i + 1]
        pivot = pivot if abs(pivot) > tiny else -tiny
        down[i] = q[i] * e[i] / pivot
        p[i] = p[i + 1] * (q2[i] / pivot) - value
    twist = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -down[i] * z[i]
    return z / np.linalg.norm(z)


def directions(q: np.ndarray, e: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): squared singular values above rounding, falling, and their right vectors as columns."""
    n, scale = len(q), max(float(np.abs(q).max(initial=0)), float(np.abs(e).max(initial=0)))
    if scale == 0.0:
        return np.zeros(0), np.zeros((n, 0))
    e = np.where(np.abs(e) <= EPS * EPS * scale, 0.0, e)
    edges = [0, *(np.flatnonzero(e == 0.0) + 1).tolist(), n]
    found = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):  # blocks that nothing couples
        q_, e_ = q[a:b] / scale, e[a : b - 1] / scale
        found += [(float(v), a, b) for v in dqds(q_ * q_, e_ * e_)]
    found = [x for x in sorted(found, key=lambda x: -x[0]) if x[0] > 0.0]
    found = [x for x in found if x[0] > RANK**2 * found[0][0]][:most]
    vectors = np.zeros((n, len(found)))
    for k, (value, a, b) in enumerate(found):
        vectors[a:b, k] = twisted(q[a:b] / scale, e[a : b - 1] / scale, value)
    values = np.array([v for v, _, _ in found])
    if len(found) and np.abs(vectors.T @ vectors - np.eye(len(found))).max() > 1e-12:  # values too close to part their vectors
        vectors = parted(q / scale, e / scale, values, vectors)
    return values * scale * scale, vectors


def parted(q: np.ndarray, e: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Orthogonal vectors for clusters of values. Each vector is freed of those before it; where little is left of it, a
    new one of the cluster is iterated inversely from a random start."""
    t = np.diag(q * q + np.append(0.0, e * e)) + np.diag(q[:-1] * e, 1) + np.diag(q[:-1] * e, -1)
    out, random = vectors.copy(), np.random.default_rng(13)

    def freed(z, before):
        z = z / np.linalg.norm(z)
        for _ in range(2):
            z = z - before @ (before.T @ z)
        return z

    for k in range(len(values)):
        z = freed(out[:, k], out[:, :k])
        if np.linalg.norm(z) < 0.01:
            z = freed(random.standard_normal(len(z)), out[:, :k])
            for _ in range(4):
                z = freed(np.linalg.solve(t - (values[k] + 4 * EPS) * np.eye(len(z)), z), out[:, :k])
        out[:, k] = freed(z, out[:, :k])
        out[:, k] /= np.linalg.norm(out[:, k])
    return out


class Whitening:
    """Components (a column each) and their eigenvalues, of vectors with these sums; `trace` is that of all."""

    def __init__(self, sums: Sums, components: np.ndarray, values: np.ndarray, trace: float):
        self.sums, self.components, self.values, self.trace = sums, components, values, trace

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.sums.centred(x) @ self.components / np.sqrt(self.values)


def fit(rows: DataFrame, most: int) -> Whitening | None:
    """Learns from all of `rows` (usable())."""
    sums = sums_of(rows)
    if sums is None:
        return None
    r = triangle(rows, sums)
    if len(r) < r.shape[1]:
        r = np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])
    q, e, w = bidiagonal(r)
    values, vectors = directions(q, e, most)
    return Whitening(sums, w @ vectors, values / sums.n, float((r * r).sum()) / sums.n)


def identity_error(rows: DataFrame, found: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity; tasks' means and products are merged."""
    k = len(found.values)

    def run(batches):
        import pyarrow as pa

        n, mean, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if m := len(batch):
                y = found.apply(numbers(batch))
                own = y.mean(axis=0)
                y, gap = y - own, own - mean
                products += y.T @ y + np.outer(gap, gap) * (n * m / (n + m))
                mean, n = mean + gap * (m / (n + m)), n + m
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k), pa.int32()), pa.array(np.full(k * k, float(n))), pa.array(np.repeat(mean, k)), pa.array(np.tile(mean, k)), pa.array(products.ravel())], ["entry", "n", "x", "y", "xy"])

    parts = rows.select("vec").mapInArrow(run, "entry int, n double, x double, y double, xy double")
    total = parts.groupBy("entry").agg(F.sum("n").alias("n"), F.sum("xy").alias("xy"), F.sum(F.expr("n * x")).alias("x"), F.sum(F.expr("n * y")).alias("y"), F.sum(F.expr("n * x * y")).alias("means"))
    got = total.select("entry", F.expr("(xy + means - x * y / n) / n").alias("covariance"))
    return got.agg(F.max(F.abs(F.col("covariance") - F.when(F.col("entry") % (k + 1) == 0, 1.0).otherwise(0.0)))).first()[0]


def whiten(vectors: DataFrame, column: str = "embedding", most: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    rows = usable(vectors, column)
    found = fit(rows, most)
    schema = f"vec_id {dict(vectors.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if found is None or not len(found.values):
        return vectors.sparkSession.createDataFrame([], schema)
    error, k = identity_error(rows, found), len(found.values)

    def run(batches):
        import pyarrow as pa

        names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                x, m = numbers(batch), len(batch)
                ids = batch["vec_id"].take(pa.array(np.repeat(np.arange(m), k)))
                deviation = pa.array(found.sums.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                numbers_ = pa.array(np.tile(np.arange(1, k + 1), m), pa.int32())
                yield pa.RecordBatch.from_arrays([ids, numbers_, pa.array(np.full(m * k, found.sums.n)), deviation, pa.array(found.apply(x).ravel()), pa.array(np.tile(found.values / found.trace, m)), pa.array(np.full(m * k, error))], names)

    return rows.mapInArrow(run, schema)


def op13_whitening(spark, sf_dir):
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
