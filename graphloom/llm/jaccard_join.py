"""N-gram Jaccard join with R-trees over count vectors.

A document's set is its distinct five-word shingles, as 64-bit hashes. Two link at a Jaccard similarity of 0.8 or more.

1. Documents with equal sets are one class; one of them stands for it.
2. Two linked sets share a shingle among the first n - ceil(0.8 n) + 1 of each in any common order. Heavy shingles come
   last in that order (a sketch of fixed size finds them), so the groups of a shared shingle stay small.
3. In each such group the classes of least and of greatest key are hubs. Pairs of a class and a hub are bounded by their
   count vectors, verified on their texts, and joined into components. Groups of more than a leaf that still hold several
   components get four further hubs a round, for as long as that joins components. So most near copies link by few pairs.
4. Groups that still hold several components are cut into cells of like set sizes, and cells of one least member are
   one cell, so that a pair meets in few of them. Shingles are hashed into coordinates, about one for eight shingles
   (in large cells two for each), each class is the point of its counts, an R-tree holds the cell's points, and a search
   descends where another component is and where the sum of coordinate minima with a node's upper corner still allows
   the needed overlap. Points of twice the coordinates are folded to meet. Surviving pairs between components are
   verified. Cells of one leaf are compared point by point; a large one is searched block against block, so that a task
   holds a bounded number of points.

No link between different components is lost: each pair in a group is bounded by a tree, and bounds never exclude a link.

Defined results: null text and text without words have an empty set and link with nothing; fewer than five words are one
shingle; a null doc_id links with nothing and has a null component; rows that repeat a doc_id are one document, which
has the links of any of its texts; an empty table gives an empty table; other columns are ignored by `link`.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.components import components
from graphloom.llm.shared import bounded, give_back, light_batches, staged, unstaged
from graphloom.llm.tokens import WordEncoder, slices
from graphloom.llm.wordhash import Runs, mix, words_of

SHINGLE = 5
#: Shingles for one coordinate of a point, least and most coordinates (powers of two); the same for fine points.
COARSE, FINE = (8, 32, 2048), (0.5, 128, 4096)
#: Slots of the sketch of heavy shingles; points in an R-tree's leaf; groups above this get more hubs, and cells fine points.
SLOTS, LEAF, LARGE, FINE_ABOVE = 1 << 20, 4, 32, 256
#: Rows and bytes of points that a task of the cell search takes, and bytes of a block and of what is compared at once.
TASK_ROWS, TASK_BYTES, BLOCK_BYTES, POINT_BYTES = 4_000, 2_000_000, 1_000_000, 2_000_000
#: Sets that may link lie in the same or in neighbouring bands of sizes: a band is a little wider than the ratio 1.25.
BAND = 1.26
#: A coordinate of a point that doesn't fit bytes: it bounds nothing.
FULL = 1 << 19
#: Bytes of text that a task turns into sets at once.
SLICE = 250_000
#: Up to so many doc_ids (8 bytes each) are broadcast to pick their texts; beyond, the texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def sets_of(column):
    """(shingles, first): the distinct shingles of each text, sorted within it; text i has first[i] to first[i + 1]."""
    words, first = words_of(column, lower=True)
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1)))
    count = np.bincount(text, minlength=len(n))
    offset = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = first[text] + offset
    h = Runs(words).hash(start, start + np.minimum(n[text], SHINGLE)) if len(text) else np.zeros(0, np.uint64)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))[: len(h)]
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(n) + 1))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
    return total[first[1:]] - total[first[:-1]]


def coordinates(n: np.ndarray, grain=COARSE) -> np.ndarray:
    """The number of coordinates for a set of n shingles: the power of two from n / grain on, within bounds. Sets that
    may link differ by a factor of two at most."""
    per, least, most = grain
    return np.clip(1 << np.ceil(np.log2(np.maximum(n / per, 1))).astype(np.int64), least, most)


def points(h: np.ndarray, first: np.ndarray, grain=COARSE) -> list[bytes]:
    """Counts of each set's shingles by group, as bytes. Where a count reaches 255 the whole point is 255s."""
    n = np.diff(first)
    d = coordinates(n, grain)
    offset = np.append(0, np.cumsum(d))
    own = np.repeat(np.arange(len(n)), n)
    counts = np.bincount(offset[own] + (mix(h, 5) % d[own].astype(np.uint64)).astype(np.int64), minlength=offset[-1])
    out = []
    for i, j in zip(offset[:-1].tolist(), offset[1:].tolist(), strict=True):
        c = counts[i:j]
        out.append((c if c.max(initial=0) < 255 else np.full(j - i, 255)).astype(np.uint8).tobytes())
    return out


def counts_of(v: list[bytes]) -> np.ndarray:
    """The counts of points of one length, a row each."""
    p = np.frombuffer(b"".join(v), np.uint8).reshape(len(v), -1).astype(np.int32)
    p[p[:, 0] == 255] = FULL
    return p


def classes(docs: DataFrame) -> DataFrame:
    """id, n, k1, k2 (which name the set) and v (its point) of each row, and after them the rows of a sketch of heavy
    shingles, which have n = -1, a slot as k1 and its count as k2: one pass over the texts gives both."""

    def run(batches):
        import pyarrow as pa

        WordEncoder.leave()
        give_back()
        names, count = ["id", "n", "k1", "k2", "v"], np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in slices(batch, SLICE):
                h, first = sets_of(part["text"])
                count += np.bincount((h % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(np.diff(first).astype(np.int64)), pa.array(_sums(mix(h, 6), first).view(np.int64)), pa.array(_sums(mix(h, 7), first).view(np.int64)), pa.array(points(h, first), pa.binary())], names)
        mean = count.mean()
        heavy = np.flatnonzero(count > mean + 6 * np.sqrt(mean) + 8)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(heavy), pa.int64()), pa.array(np.full(len(heavy), -1)), pa.array(heavy), pa.array(count[heavy]), pa.nulls(len(heavy), pa.binary())], names)

    return docs.select("id", "text").mapInArrow(run, "id long, n long, k1 long, k2 long, v binary")


def heavy_slots(sets: DataFrame) -> np.ndarray:
    """A byte for each slot of the sketch: 0, or the logarithm of how often its shingles occur where that is far above
    the mean. It only orders shingles: links don't depend on how well it counts."""
    rows = sets.where("n = -1").groupBy(F.col("k1").alias("slot")).agg(F.sum("k2").alias("n")).toPandas()  # SLOTS rows at most
    out = np.zeros(SLOTS, np.uint8)
    if len(rows):
        out[rows["slot"].to_numpy(np.int64)] = np.log2(rows["n"].to_numpy(np.float64)).astype(np.uint8) * 4
    return out


def prefixes(docs: DataFrame, heavy: np.ndarray) -> DataFrame:
    """s, k1: the prefix shingles of each class; rows that meet in a task are sent once."""
    packed = np.packbits(heavy > 0).tobytes(), heavy[heavy > 0].tobytes()

    def run(batches):
        import pyarrow as pa

        give_back()
        weight = np.unpackbits(np.frombuffer(packed[0], np.uint8)).astype(np.uint8)
        weight[weight > 0] = np.frombuffer(packed[1], np.uint8)
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, SLICE):
                h, first = sets_of(part["text"])
                n = np.diff(first)
                k1 = _sums(mix(h, 6), first)
                fresh = np.zeros(len(n), bool)
                if len(seen) > 500_000:
                    seen.clear()
                for i, key in enumerate(k1.tolist()):
                    if n[i] and key not in seen:
                        seen.add(key)
                        fresh[i] = True
                text = np.repeat(np.arange(len(n)), n)
                h, own = h[fresh[text]], text[fresh[text]]
                order = np.lexsort((mix(h, 8), weight[(h % np.uint64(SLOTS)).astype(np.int64)], own))
                own = own[order]
                place = np.arange(len(h)) - np.searchsorted(own, own)
                keep = place < (n - (4 * n + 4) // 5 + 1)[own]
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(h[order][keep].view(np.int64)), pa.array(k1[own[keep]].view(np.int64))], ["s", "k1"])

    return docs.select("text").mapInArrow(run, "s long, k1 long")


def needed(na, nb):
    """The least overlap of two linked sets: 100 i >= 80 (na + nb - i)."""
    return (4 * (na + nb) + 8) // 9


class CountTree:
    """R-tree over count vectors, packed by splitting at the median of the widest coordinate. A node keeps its points'
    greatest counts, the least set size, and their component where it is one."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, comps: np.ndarray):
        self.points, self.sizes, self.comps = points, sizes, comps
        self.root = self._node(np.arange(len(points)))

    def _node(self, rows: np.ndarray):
        at, comp = self.points[rows], self.comps[rows]
        corner, least, only = at.max(0), self.sizes[rows].min(), comp[0] if (comp == comp[0]).all() else None
        if len(rows) <= LEAF:
            return corner, least, only, rows, None
        order = np.argsort(at[:, np.argmax(corner - at.min(0))], kind="stable")
        half = len(rows) // 2
        return corner, least, only, None, (self._node(rows[order[:half]]), self._node(rows[order[half:]]))

    def search(self, points: np.ndarray, sizes: np.ndarray, comps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) pairs of different components whose sum of coordinate minima reaches the overlap that a link
        needs. All queries go down the tree together, each as far as the bound lets it."""
        out, todo = [np.zeros((2, 0), np.int64)], [(self.root, np.arange(len(points)))]
        while todo:
            (corner, least, only, rows, children), q = todo.pop()
            if only is not None:
                q = q[comps[q] != only]
            q = q[np.minimum(points[q], corner).sum(1) >= needed(sizes[q], least)]
            if children:
                todo.extend((c, q) for c in children if len(q))
                continue
            step = max(1, POINT_BYTES // (len(rows) * len(corner)))
            for at in range(0, len(q), step):
                part = q[at : at + step]
                close = np.minimum(points[part][:, None], self.points[rows]).sum(2) >= needed(sizes[part][:, None], self.sizes[rows])
                i, j = np.nonzero(close & (comps[part][:, None] != self.comps[rows]))
                out.append(np.stack([part[i], rows[j]]))
        return tuple(np.concatenate(out, 1))


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of `docs` (id, text) with one of the ids, without a shuffle of the texts where the ids are few."""
    ids = staged(ids, "text-ids")
    return docs.select("id", "text").join(F.broadcast(ids) if bounded(ids, BROADCAST_IDS) else ids, "id", "left_semi")


def _fine_points(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """id, n and the fine point v of each text of the ids."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, SLICE):
                h, first = sets_of(part["text"])
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(np.diff(first).astype(np.int64)), pa.array(points(h, first, FINE), pa.binary())], ["id", "n", "v"])

    return _texts_of(ids, docs).mapInArrow(run, "id long, n long, v binary")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of doc_ids whose texts link, by the shingles of both texts hashed anew. Only the texts
    that occur in a pair move."""
    texts = _texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), docs)
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches):
        import pyarrow as pa

        give_back()
        for batch in batches:
            for part in slices(batch, SLICE, "ta"):
                for half in slices(part, SLICE, "tb"):
                    sides = []
                    for c in ("ta", "tb"):  # a text that many pairs of the slice have is taken apart once
                        coded = half[c].dictionary_encode()
                        h, first = sets_of(coded.dictionary)
                        sides.append([h[first[i] : first[i + 1]] for i in coded.indices.to_pylist()])
                    keep = []
                    for p, q in zip(*sides, strict=True):
                        common = len(np.intersect1d(p, q, assume_unique=True)) if 5 * min(len(p), len(q)) >= 4 * max(len(p), len(q)) else 0
                        keep.append(common > 0 and 100 * common >= 80 * (len(p) + len(q) - common))
                    keep = pa.array(keep, pa.bool_())
                    yield pa.RecordBatch.from_arrays([half["a"].filter(keep), half["b"].filter(keep)], ["a", "b"])

    return both.where("ta IS NOT NULL AND tb IS NOT NULL").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def fold(v: np.ndarray, d: int) -> np.ndarray:
    """Points of more coordinates as points of d."""
    return v.reshape(len(v), -1, d).sum(1) if v.shape[1] > d else v


def bounded_rows(va: list[bytes], na: np.ndarray, vb: list[bytes], nb: np.ndarray) -> np.ndarray:
    """For each pair of points, whether its sum of coordinate minima allows a link."""
    la, lb = np.array([len(x) for x in va], np.int64), np.array([len(x) for x in vb], np.int64)
    keep = np.zeros(len(va), bool)
    size = (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)) & (np.maximum(la, lb) <= 2 * np.minimum(la, lb))
    for x, y in {*zip(la[size].tolist(), lb[size].tolist(), strict=True)}:
        rows = np.flatnonzero(size & (la == x) & (lb == y))
        step = max(1, POINT_BYTES // (x + y))
        for at in range(0, len(rows), step):
            r = rows[at : at + step]
            p, q = counts_of([va[i] for i in r.tolist()]), counts_of([vb[i] for i in r.tolist()])
            keep[r] = np.minimum(fold(p, min(x, y)), fold(q, min(x, y))).sum(1) >= needed(na[r], nb[r])
    return keep


def _allowed(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids, from pairs (ka, kb) of the keys of `points` (key, rep, n, v), that their sizes and then their
    points allow. Sizes meet first, so that few points are sent."""
    size = points.select(F.col("key").alias("ka"), F.col("n").alias("na"))
    left = points.select(F.col("key").alias("ka"), F.col("rep").alias("a"), F.col("v").alias("va"))
    right = points.select(F.col("key").alias("kb"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("v").alias("vb"))
    met = pairs.join(size, "ka").join(right, "kb").where("5 * least(na, nb) >= 4 * greatest(na, nb)").join(left, "ka").where("a <> b")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, POINT_BYTES, "va"):
                for half in slices(part, POINT_BYTES, "vb"):
                    keep = pa.array(bounded_rows(half["va"].to_pylist(), half["na"].to_numpy(), half["vb"].to_pylist(), half["nb"].to_numpy()))
                    yield pa.RecordBatch.from_arrays([half["a"].filter(keep), half["b"].filter(keep)], ["a", "b"])

    return met.select("a", "na", "va", "b", "nb", "vb").mapInArrow(run, "a long, b long").distinct()


def tree_pairs(v: list[bytes], n: np.ndarray, left: np.ndarray, right: np.ndarray, comp: np.ndarray) -> np.ndarray:
    """Row pairs of left and right, of different components, that the trees let through. Trees hold points of equal
    coordinates; points of twice as many are folded."""
    d, out = np.array([len(x) for x in v]), [np.zeros((0, 2), np.int64)]
    point = lambda rows, k: fold(counts_of([v[i] for i in rows.tolist()]), k)
    for k in np.unique(d[right]).tolist():
        at, own = right[d[right] == k], None
        for e in (k // 2, k, 2 * k):
            asked = left[d[left] == e]
            if len(asked):
                tree = CountTree(point(at, e), n[at], comp[at]) if e < k else own or CountTree(point(at, k), n[at], comp[at])
                own = own if e < k else tree
                q, r = tree.search(point(asked, min(e, k)), n[asked], comp[asked])
                out.append(np.stack([asked[q], at[r]], 1))
    return np.concatenate(out)


def cell_pairs(pdf):
    """Pairs (a, b) of ids of different components that points let through, within each cell of a task. Columns: g1 and
    cell (the cell), i and j (blocks), block, band, id, n, v, component. Cells of one leaf are compared together."""
    import pandas as pd

    pdf = pdf.sort_values(["g1", "cell", "i", "j", "id"]).reset_index(drop=True)
    ids, n, comp, block = (pdf[c].to_numpy() for c in ("id", "n", "component", "block"))
    top = (pdf["band"] == pdf["cell"]).to_numpy()  # a pair is searched in the cell of its greater band
    v = pdf["v"].tolist()
    place = pdf.groupby(["g1", "cell", "i", "j"], sort=False).ngroup().to_numpy()
    edges = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])), len(place))
    size = np.diff(edges)
    out, leaf = [np.zeros((0, 2), np.int64)], size <= LEAF
    in_leaf = leaf[place]
    for k in range(1, min(LEAF, len(place))):
        x = np.flatnonzero(in_leaf[:-k] & (place[:-k] == place[k:]))
        y = x + k
        ok = (comp[x] != comp[y]) & (top[x] | top[y])
        out.append(np.stack([x[ok], y[ok]], 1))
    close = np.concatenate(out)
    pairs = np.sort(np.stack([ids[close[:, 0]], ids[close[:, 1]]], 1), 1)
    pairs, where = np.unique(pairs, axis=0, return_index=True)
    a, b = close[where, 0], close[where, 1]
    found = [pairs[bounded_rows([v[i] for i in a.tolist()], n[a], [v[i] for i in b.tolist()], n[b])]] if len(pairs) else []
    for c in np.flatnonzero(~leaf).tolist():
        rows = np.arange(edges[c], edges[c + 1])
        i, j = pdf["i"].iloc[rows[0]], pdf["j"].iloc[rows[0]]
        got = tree_pairs(v, n, rows[block[rows] == i], rows[block[rows] == j], comp)
        got = got[top[got[:, 0]] | top[got[:, 1]]]
        found.append(np.sort(ids[got], 1))
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _cells(open_groups: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The members (with points) of the cells that hold pairs of different components, dealt to tasks by bytes."""
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(BAND)).cast("int")
    sized = open_groups.select("g", "rep", "component").join(reps.select("rep", "n"), "rep").withColumn("band", band)
    placed = staged(sized.withColumn("cell", F.explode(F.array("band", F.col("band") + 1))), "placed")
    split = placed.groupBy("g", "cell").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.max("band").alias("top"), F.min("rep").alias("g1")).where("c1 <> c2 AND top = cell")
    met = staged(placed.join(split.select("g", "cell", "g1"), ["g", "cell"]).select("g1", "cell", "rep", "n", "band", "component").distinct(), "cell-members")
    unstaged(placed)
    size = met.groupBy("g1", "cell").agg(F.count(F.lit(1)).alias("size"), F.max("n").alias("most")).withColumn("fine", F.col("size") > FINE_ABOVE)
    width = lambda grain: F.least(F.greatest(F.col("most") * (2 / grain[0]), F.lit(grain[1])), F.lit(grain[2]))
    size = size.withColumn("bytes", F.when(F.col("fine"), width(FINE)).otherwise(width(COARSE)) * F.col("size"))
    cells = staged(size.withColumn("blocks", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int")), "cells")
    tasks = max(1, math.ceil(cells.agg(F.sum(F.col("blocks") * F.greatest(F.col("bytes") / TASK_BYTES, F.col("size") / TASK_ROWS))).first()[0] or 0))
    dealt = met.join(cells.select("g1", "cell", "blocks", "fine"), ["g1", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    task = F.pmod(F.xxhash64("g1", "cell", "i", "j"), F.lit(tasks)).alias("task")
    dealt = dealt.select("g1", "cell", "i", "j", "block", "band", F.col("rep").alias("id"), "n", "component", "fine", task)
    fine = _fine_points(dealt.where("fine").select("id").distinct(), docs)
    coarse = reps.select(F.col("rep").alias("id"), "n", "v")
    return dealt.where("NOT fine").join(coarse, ["id", "n"]).unionByName(dealt.where("fine").join(fine, ["id", "n"]))


def link(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n_shingles, component_id."""
    light_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    passed = staged(classes(rows), "sets")
    sets = passed.where("n >= 0")
    named = sets.where("n > 0 AND id IS NOT NULL")
    reps = staged(named.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("v").alias("v")), "classes")
    shingles = staged(prefixes(rows.where("id IS NOT NULL"), heavy_slots(passed)), "prefixes")
    hubs = shingles.groupBy("s").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).where("lo <> hi")
    shared = staged(shingles.join(hubs, "s").select("s", "k1", "lo", "hi"), "shared-shingles")
    unstaged(shingles)

    stars = shared.select(F.col("k1").alias("ka"), F.explode(F.array("lo", "hi")).alias("kb")).where("ka <> kb").distinct()
    near = staged(_allowed(stars, reps.withColumnRenamed("k1", "key")), "star-pairs")
    links = staged(verified(near, rows), "star-links")
    # A doc_id with several texts is one document: its classes are linked.
    own = named.join(reps.select("k1", "k2", "rep"), ["k1", "k2"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    several = named.select("id", "k1", "k2").distinct().groupBy("id").count().where("count > 1").select(F.col("id").alias("a"))
    links = links.union(own.join(several, "a").distinct())
    found = staged(components(links), "star-components")

    def component_of(df: DataFrame, column: str) -> DataFrame:
        return df.join(found.select(F.col("id").alias(column), "component"), column, "left").withColumn("component", F.coalesce("component", column))

    def still_open(df: DataFrame) -> DataFrame:
        """Members (with component) of the groups that hold several components."""
        several = df.groupBy("g").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("g")
        return df.join(several, "g")

    member = shared.select("s", "k1").distinct().join(reps.select("k1", "rep"), "k1").select("s", "rep")
    mark = [F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"m{k}") for k in (1, 2)]
    groups = member.groupBy("s").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("g1"), *mark)
    groups = groups.groupBy("size", "g1", "m1", "m2").agg(F.min("s").alias("s"))  # shingles with the same members: one group
    grouped = staged(member.join(groups.select("s", "g1", "size"), "s").withColumnRenamed("s", "g"), "groups")
    unstaged(shared)

    # Further hubs, four a round, for the larger groups, for as long as they join components.
    before, turn = None, 0
    while True:
        live = staged(still_open(component_of(grouped.where(F.col("size") > LARGE), "rep")), "open-groups")
        left = live.select("component").distinct().count()
        if not left or before is not None and 10 * left > 9 * before:
            break
        picks = [F.min(F.struct(F.xxhash64("rep", F.lit(4 * turn + k)).alias("h"), "rep", "component")).alias(f"p{k}") for k in range(4)]
        more = live.groupBy("g").agg(*picks).select("g", F.explode(F.array(*[F.col(f"p{k}") for k in range(4)])).alias("p"))
        pairs = live.join(more, "g").where("component <> p.component").select(F.least("rep", "p.rep").alias("ka"), F.greatest("rep", "p.rep").alias("kb")).distinct()
        near = staged(_allowed(pairs, reps.withColumn("key", F.col("rep"))), "hub-pairs")
        links = staged(links.unionByName(verified(near, rows)), "hub-links")
        found = staged(components(links), "hub-components")
        unstaged(live, near)
        before, turn = left, turn + 1

    members = _cells(still_open(component_of(grouped, "rep")), reps, rows)
    searched = staged(members.groupBy("task").applyInPandas(cell_pairs, "a long, b long").distinct(), "tree-pairs")
    more = staged(verified(searched, rows), "tree-links")
    if not more.isEmpty():
        found = staged(components(links.unionByName(more)), "components")
    unstaged(grouped, searched)
    joined = sets.join(reps.select("k1", "k2", "rep"), ["k1", "k2"], "left").withColumn("rep", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("rep")).otherwise(F.col("id")))
    return component_of(joined, "rep").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, one of each group of linked ones (that of the least doc_id); documents
    with an empty set or a null doc_id all stay."""
    found = link(docs.select("doc_id", "text")).where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti")


def op4_jaccard_join(spark, sf_dir):
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM common JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * c >= 80 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.m AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON d.doc_id = r.a
"""
