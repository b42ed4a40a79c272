"""Prefix trie of conversations, with count-min screening of prefix digests.

A prefix's digest is the XOR of 128-bit hashes of its turns with their positions, so digests of all prefixes are running
XORs. A count-min sketch counts them: where a prefix's estimate is one, no other conversation has it, nor any longer one,
and the conversation's tail from there on is emitted as it stands. Only prefixes above it, which may be shared, are
shuffled by digest and grouped exactly. A node is named by its smallest member and its depth.

Sums over subtrees need no pass per level. Along a conversation's path the smallest member only grows, so a conversation
is the smallest member of a node from one depth on, its entry, down to its end. Nodes are counted where their smallest
member is, each conversation brings its own leaf and tokens to the nodes above its entry, and these are sums over members.

The sketch has counters of at most 2 and CELLS of them at most; beyond that more prefixes are grouped exactly and the
result is the same. Long conversations are numbered and XORed in blocks of BLOCK turns, and the ids that end at one node
are hashed in order from pieces of ENDS ids, so that no group is held in memory.

Defined results: turns are ordered by turn (null first), then role, then text; null role or text is ''; repeated rows are
turns of their own; rows without a conv_id belong to no conversation and are ignored; an empty table gives no node; other
columns are ignored. Digests are 128 bits wide and aren't compared with the turns' texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.shared import split_words, staged, unstaged
from graphloom.llm.wordhash import mix

BLOCK, ENDS = 1024, 512
#: Counters of the sketch at most (a byte each), its rows, and counters in a piece of it that is merged and sent on its own.
CELLS, ROWS, PIECE = 1 << 26, 4, 1 << 16
NODE = ["depth", "a", "b"]


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, i (from 0), role, text: each conversation's turns in order."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]).where("conv_id IS NOT NULL")
    rows = rows.withColumn("block", F.coalesce(F.expr(f"turn div {BLOCK}"), F.lit(-(2**63))))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv_id", "block").count().select("conv_id", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.withColumn("n", F.row_number().over(within)).join(sizes, ["conv_id", "block"]).select("conv_id", (F.col("before") + F.col("n") - 1).alias("i"), "role", "text")


def rebuild(conversations: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after each conversation's first h turns, h being crc32 of its id modulo `heads`, are replaced
    by the first h of its group's first conversation: conv_id, n_turns; conv_id, i, role, text."""
    turns = staged(numbered(conversations), "turns")
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    own = sizes.select("conv_id", "n_own", F.expr(f"conv_id - conv_id % {group}").alias("first"), (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h"))
    shared = sizes.select(F.col("conv_id").alias("first"), F.col("n_own").alias("n_first"))
    convs = own.join(shared, "first", "left").withColumn("taken", F.least("h", F.coalesce("n_first", F.lit(0)))).withColumn("n_turns", F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0)))
    convs = staged(convs, "conversations")
    kept = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("i >= h").select("conv_id", (F.col("i") - F.col("h") + F.col("taken")).alias("i"), "role", "text")
    given = turns.where(f"i < {heads - 1} AND conv_id % {group} = 0").withColumnRenamed("conv_id", "first").join(convs.select("conv_id", "first", "h"), "first").where("i < h").select("conv_id", "i", "role", "text")
    return convs.select("conv_id", "n_turns"), kept.unionByName(given)


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, depth, a and b (the prefix's digest), above_a and above_b (the one above), words of the last text, n_turns."""
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(" "), "role", "text"), 256)
    rows = turns.select("conv_id", (F.col("i") + 1).alias("depth"), F.expr(f"i div {BLOCK}").alias("block"), said.alias("said"), F.size(split_words(F.col("text"))).cast("long").alias("words"))
    rows = rows.select("conv_id", "depth", "block", "words", F.xxhash64("depth", "said").alias("x"), F.xxhash64("said", "depth").alias("y"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    blocks = blocks.select("conv_id", "block", *[F.coalesce(F.bit_xor(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("x", "y")])
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("xs", F.bit_xor("x").over(within)).withColumn("ys", F.bit_xor("y").over(within)).join(blocks, ["conv_id", "block"])
    rows = rows.select("conv_id", "depth", F.expr("xs ^ x_before").alias("a"), F.expr("ys ^ y_before").alias("b"), F.expr("xs ^ x_before ^ x").alias("above_a"), F.expr("ys ^ y_before ^ y").alias("above_b"), "words")
    none = F.lit(0).cast("long")
    roots = convs.select("conv_id", none.alias("depth"), none.alias("a"), none.alias("b"), F.lit(None).cast("long").alias("above_a"), F.lit(None).cast("long").alias("above_b"), none.alias("words"))
    return rows.unionByName(roots).join(convs, "conv_id")


def cells_of(batch, width: int) -> np.ndarray:
    """The sketch's counters of each prefix: one array per row of the sketch."""
    depth, a, b = (batch[c].to_numpy(zero_copy_only=False).view(np.uint64) for c in NODE)
    return np.stack([mix(a ^ mix(b + depth, 7), r) % np.uint64(width) + np.uint64(r * width) for r in range(ROWS)]).astype(np.int64)


def sketch(found: DataFrame, width: int) -> np.ndarray:
    """Counters (2 for two and more) of `found`'s prefixes; ROWS rows of `width` each."""
    schema = "piece int, counts binary"

    def count(batches):
        import pyarrow as pa

        own = np.zeros(ROWS * width, np.uint8)
        for batch in batches:
            cells, n = np.unique(cells_of(batch, width), return_counts=True)
            own[cells] = np.minimum(own[cells] + np.minimum(n, 2), 2)
        used = np.flatnonzero(own)
        for piece, at in zip(*np.unique(used // PIECE, return_index=True), strict=True):
            cells = used[at : np.searchsorted(used, (piece + 1) * PIECE)]
            packed = (cells % PIECE * 2 + (own[cells] > 1)).astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([packed])], ["piece", "counts"])

    def merge(batches):
        import pyarrow as pa

        at, total = None, np.zeros(PIECE, np.uint8)
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()])], ["piece", "counts"])
        for batch in batches:
            for piece, packed in zip(batch["piece"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                if piece != at:
                    if at is not None:
                        yield row()
                    at, total = piece, np.zeros(PIECE, np.uint8)
                packed = np.frombuffer(packed, "<u4")
                total[packed // 2] = np.minimum(total[packed // 2] + packed % 2 + 1, 2)
        if at is not None:
            yield row()

    out = np.zeros(-(-ROWS * width // PIECE) * PIECE, np.uint8)
    merged = found.select(*NODE).mapInArrow(count, schema).repartition("piece").sortWithinPartitions("piece").mapInArrow(merge, schema)
    for piece, counts in merged.toLocalIterator():
        out[piece * PIECE : (piece + 1) * PIECE] = np.frombuffer(counts, np.uint8)
    return out


def first_singletons(found: DataFrame, cells: int = CELLS) -> DataFrame:
    """conv_id and `single`: the least depth at which the sketch proves that no other conversation has the prefix."""
    turns = found.where("depth > 0").select("conv_id", *NODE)
    width = min(max(1 << (8 * turns.count()).bit_length(), 1024), cells // ROWS)
    counts = found.sparkSession.sparkContext.broadcast(sketch(turns, width))

    def screen(batches):
        import pyarrow as pa

        for batch in batches:
            single = counts.value[cells_of(batch, width)].min(axis=0) == 1
            yield batch.select(["conv_id", "depth"]).filter(pa.array(single))

    return turns.mapInArrow(screen, "conv_id long, depth long").groupBy("conv_id").agg(F.min("depth").alias("single"))


def hashed_ends(ends: DataFrame) -> DataFrame:
    """For each node the SHA-256 of the comma-joined, ascending conv_ids in `ends` (depth, a, b, conv_id)."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        at, sha = None, None
        row = lambda: pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in at], pa.array([sha.hexdigest()])], [*NODE, "ends_sha256"])
        for batch in batches:
            for *node, ids in zip(*[batch[c].to_pylist() for c in [*NODE, "ids"]], strict=True):
                if node != at:
                    if at is not None:
                        yield row()
                    at, sha = node, hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
        if at is not None:
            yield row()

    pieces = ends.groupBy(*NODE, F.expr(f"conv_id div {ENDS}").alias("piece")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, cells: int = CELLS) -> DataFrame:
    """The trie's nodes, of conversations (conv_id, n_turns) and their turns (conv_id, i from 0, role, text)."""
    found = staged(prefixes(convs, turns), "prefixes")
    known = staged(convs.join(first_singletons(found, cells), "conv_id", "left").select("conv_id", "n_turns", F.coalesce("single", F.col("n_turns") + 1).alias("single")), "singletons")
    maybe = found.join(known.select("conv_id", "single"), "conv_id").where("depth < single")

    # Nodes that may be shared, exactly: smallest member, members, and how many end there.
    ends = F.sum((F.col("depth") == F.col("n_turns")).cast("long")).alias("n_ends")
    nodes = staged(maybe.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), ends), "nodes")
    if nodes.isEmpty():
        return nodes.selectExpr("conv_id", "depth", "conv_id AS parent_conv_id", "n_convs", "n_convs AS n_children", "n_convs AS n_leaves", "n_convs AS saved_tokens", "'' AS ends_sha256")
    root = nodes.where("depth = 0").first()["conv_id"]

    # What each conversation brings: its entry, the tokens saved at nodes whose smallest member it is, and its leaf.
    saved = (F.col("n_convs") - 1) * F.col("words")
    smallest = nodes.groupBy("conv_id").agg(F.min("depth").alias("least"), F.sum(saved).alias("total"), F.max(F.struct("depth", (F.col("n_convs") == F.col("n_ends")).alias("childless"))).alias("last"))
    alone = F.col("single") <= F.col("n_turns")
    brings = known.join(smallest, "conv_id", "left").select(
        "conv_id", "n_turns", "single", F.coalesce("least", F.when(alone, F.col("single"))).alias("entry"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce(alone | F.col("last.childless") & (F.col("last.depth") == F.col("n_turns")), F.lit(False)).alias("leaf")
    )
    brings = staged(brings, "members")

    # Parents of the nodes at entries; every other node's parent has the same smallest member.
    entered = found.join(brings.select("conv_id", "entry"), "conv_id").where("depth = entry AND depth > 0").select("conv_id", "depth", "above_a", "above_b")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("above_a"), F.col("b").alias("above_b"), F.col("conv_id").alias("parent_conv_id"))
    first_level = entered.where("depth = 1").select("conv_id", "depth", F.lit(root).cast("long").alias("parent_conv_id"))
    entries = staged(entered.where("depth > 1").join(above.where("depth > 1"), ["depth", "above_a", "above_b"]).select("conv_id", "depth", "parent_conv_id").unionByName(first_level), "entries")
    parent = F.coalesce("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))

    members = maybe.select("conv_id", *NODE).join(brings.drop("single"), "conv_id")
    child = (F.col("entry") == F.col("depth") + 1) | (F.col("entry") <= F.col("depth")) & (F.col("n_turns") > F.col("depth"))
    sums = members.groupBy(*NODE).agg(
        F.sum(F.when(F.col("entry") > F.col("depth"), F.col("total")).otherwise(0)).alias("others"), F.sum(F.col("leaf").cast("long")).alias("n_leaves"), F.sum(F.coalesce(child.cast("long"), F.lit(0))).alias("n_children")
    )
    from_here = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_none = F.sha2(F.lit("").cast("binary"), 256)
    shared = (
        nodes.withColumn("own", F.sum(saved).over(from_here)).join(sums, NODE).join(hashed_ends(maybe.where("depth = n_turns").select(*NODE, "conv_id")), NODE, "left").join(entries, ["conv_id", "depth"], "left")
        .select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("own") + F.col("others")).alias("saved_tokens"), F.coalesce("ends_sha256", of_none).alias("ends_sha256"))
    )
    tails = found.select("conv_id", "depth").join(brings.select("conv_id", "single", "n_turns"), "conv_id").where("depth >= single").join(entries, ["conv_id", "depth"], "left")
    one, last = F.lit(1).cast("long"), F.col("depth") == F.col("n_turns")
    ended = F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(of_none)
    tails = tails.select("conv_id", "depth", parent.alias("parent_conv_id"), one.alias("n_convs"), (~last).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), ended.alias("ends_sha256"))
    return shared.unionByName(tails)


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(*rebuild(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: crc32 by its table of 256 remainders; keys are the turns' hashes, joined.
ORACLE_SQL = r"""
WITH RECURSIVE bits(k, n, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT k, n + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE n < 8),
crc AS (SELECT list(c ORDER BY k) AS l FROM bits WHERE n = 8),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id, count(*) AS n_own, conv_id - conv_id % 20 AS first FROM turns GROUP BY conv_id),
hashed AS (SELECT own.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, x: xor(c >> 8, l[(xor(c, x) & 255) + 1])), 4294967295) % 4 AS h FROM own, crc),
convs AS (SELECT c.conv_id, c.first, c.h, least(c.h, coalesce(f.n_own, 0)) AS taken, least(c.h, coalesce(f.n_own, 0)) + greatest(c.n_own - c.h, 0) AS n_turns FROM hashed c LEFT JOIN own f ON f.conv_id = c.first),
built AS (SELECT conv_id, 0 AS depth, '' AS said, 0 AS words, n_turns FROM convs
  UNION ALL SELECT c.conv_id, t.i - c.h + c.taken + 1, sha256(length(role) || ' ' || role || text), len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')), n_turns FROM turns t JOIN convs c USING (conv_id) WHERE t.i >= c.h
  UNION ALL SELECT c.conv_id, t.i + 1, sha256(length(role) || ' ' || role || text), len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')), n_turns FROM turns t JOIN convs c ON c.first = t.conv_id WHERE t.i < c.h),
prefixes AS (SELECT conv_id, depth, words, n_turns, string_agg(said, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth) AS node FROM built),
nodes AS (SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(words) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = n_turns), '')) AS ends_sha256 FROM prefixes GROUP BY node),
above AS (SELECT v.*, u.node AS up FROM nodes v LEFT JOIN prefixes u ON u.conv_id = v.conv_id AND u.depth = v.depth - 1),
children AS (SELECT up AS node, count(*) AS n_children FROM above WHERE up IS NOT NULL GROUP BY up),
counted AS (SELECT v.*, coalesce(c.n_children, 0) AS n_children FROM above v LEFT JOIN children c USING (node)),
sums AS (SELECT u.node, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.words) AS saved_tokens FROM counted v JOIN prefixes u ON u.conv_id = v.conv_id AND u.depth <= v.depth GROUP BY u.node)
SELECT v.conv_id, v.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
FROM counted v JOIN sums s USING (node) LEFT JOIN nodes p ON p.node = v.up
"""
