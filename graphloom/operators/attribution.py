"""Attribution of references to enclosing definitions, and numbering of call sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.frames import checkpointed

#: Lines of a bucket: range joins meet on path and bucket, so a huge file is dealt to many tasks.
BUCKET_LINES = 64

LOCAL = "local "


def drop_locals(df: DataFrame) -> DataFrame:
    return df.where(~F.col("symbol").startswith(LOCAL))


def is_definition(roles: Column) -> Column:
    return roles.bitwiseAND(1) != 0


def decode_range(typed: Column, packed: Column) -> Column:
    """struct(start_line, start_character, end_line, end_character); the typed range comes first, then the packed one
    of 3 or 4 numbers. Other lengths and negative numbers are null: rows to reject."""
    at = lambda i: F.get(packed, F.lit(i))
    names = ("start_line", "start_character", "end_line", "end_character")
    made = F.when(F.size(packed) == 3, F.struct(*[at(i).alias(n) for i, n in zip((0, 1, 0, 2), names, strict=True)])).when(F.size(packed) == 4, F.struct(*[at(i).alias(n) for i, n in zip(range(4), names, strict=True)]))
    negative = F.coalesce(F.exists(packed, lambda x: x < 0), F.lit(False))
    return F.coalesce(typed, F.when(~negative, made))


def skip_reason(symbol: Column, roles: Column, is_name: Column, callable_: Column, inside: Column) -> Column:
    """Why an occurrence is no call site: the first that holds; null for call sites, `definition` isn't a skip. An
    unknown is_name passes."""
    return F.when(symbol.startswith(LOCAL), "local").when(is_definition(roles), "definition").when(~F.coalesce(is_name, F.lit(True)), "operator").when(~callable_, "non_callable").when(~inside, "outside_definition")


def skip_counts(occurrences: DataFrame) -> DataFrame:
    """reason, n of occurrences that have a column `reason`."""
    return occurrences.where("reason IS NOT NULL AND reason <> 'definition'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _containing(points: DataFrame, spans: DataFrame, key: str, half_open: bool, bucket: int) -> DataFrame:
    """Each point (line, character) with the spans of its file that contain it. Spans are copied to each bucket of
    lines that they touch, a point has one bucket, and the exact condition is left to the join's residual."""
    touched = F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.col("end_line") / bucket))
    left = points.withColumn("bucket", F.floor(F.col("line") / bucket))
    right = spans.withColumn("bucket", F.explode(touched)).withColumnRenamed(key, "_key")
    at, start, end = F.struct("line", "character"), F.struct("start_line", "start_character"), F.struct("end_line", "end_character")
    inside = (start <= at) & ((at < end) if half_open else (at <= end))
    return left.join(right, (left[key] == right["_key"]) & (left["bucket"] == right["bucket"]) & inside).drop("_key").drop("bucket")


def attribute_innermost(refs: DataFrame, defs: DataFrame, bucket: int = BUCKET_LINES) -> DataFrame:
    """ref_id, caller: the containing definition of latest start, then earliest end, then smallest symbol; both bounds
    are inside. Refs without one are left out. The least of one struct per ref is kept, so nothing is gathered."""
    own = defs.select("path", F.col("symbol").alias("caller"), "start_line", "start_character", "end_line", "end_character")
    found = _containing(refs.select("ref_id", "path", "line", "character"), own, "path", False, bucket)
    rank = F.struct((-F.col("start_line")).alias("a"), (-F.col("start_character")).alias("b"), "end_line", "end_character", "caller")
    return found.groupBy("ref_id").agg(F.min(rank).alias("best")).select("ref_id", "best.caller")


def add_innermost(refs: DataFrame, defs: DataFrame, key: list[str], bucket: int = BUCKET_LINES) -> DataFrame:
    """refs: path, r (the range), open and other columns, of which path and `key` tell them apart. Adds `caller`, that of
    attribute_innermost at the start of open refs, else null, and `bucket`. Refs are dealt by path and bucket once; joins by
    these that follow need no other shuffle."""
    own = refs.withColumn("bucket", F.floor(F.col("r.start_line") / bucket))
    touched = F.sequence(F.floor(F.col("start_line") / bucket), F.floor(F.col("end_line") / bucket))
    spans = defs.where("(start_line, start_character) <= (end_line, end_character)").select(F.col("path").alias("_path"), F.explode(touched).alias("_bucket"), F.struct((-F.col("start_line")).alias("a"), (-F.col("start_character")).alias("b"), "end_line", "end_character", F.col("symbol").alias("caller")).alias("_rank"))
    at, start, end = F.struct(F.col("r.start_line"), F.col("r.start_character")), F.struct(-F.col("_rank.a"), -F.col("_rank.b")), F.struct("_rank.end_line", "_rank.end_character")
    met = own.join(spans, (own["path"] == spans["_path"]) & (own["bucket"] == spans["_bucket"]) & F.col("open") & (start <= at) & (at <= end), "left")
    rest = [c for c in own.columns if c not in ("path", "bucket", *key)]
    best = met.groupBy("path", "bucket", *key).agg(F.min("_rank").alias("_best"), *[F.first(c).alias(c) for c in rest])
    return best.select("path", "bucket", *key, *rest, F.col("_best.caller").alias("caller"))


def locate_definition(positions: DataFrame, defs: DataFrame, bucket: int = BUCKET_LINES) -> DataFrame:
    """ref_id, symbol: the definition whose half-open range holds the position, of latest start, then last in order."""
    own = defs.select("path", F.col("symbol").alias("found"), F.col("pos").alias("def_pos"), "start_line", "start_character", "end_line", "end_character")
    held = _containing(positions.select("ref_id", "path", "line", "character"), own, "path", True, bucket)
    rank = F.struct("start_line", "start_character", "def_pos", "found")
    return held.groupBy("ref_id").agg(F.max(rank).alias("best")).select("ref_id", F.col("best.found").alias("symbol"))


def attribute_innermost_location(sites: DataFrame, functions: DataFrame, bucket: int = BUCKET_LINES) -> DataFrame:
    """ref_id, function: the containing function of greatest start, then least end."""
    own = functions.select("path", F.col("symbol").alias("function"), "start_line", "start_character", "end_line", "end_character")
    held = _containing(sites.select("ref_id", "path", "line", "character"), own, "path", False, bucket)
    rank = F.struct((-F.col("start_line")).alias("a"), (-F.col("start_character")).alias("b"), "end_line", "end_character", "function")
    return held.groupBy("ref_id").agg(F.min(rank).alias("best")).select("ref_id", "best.function")


def outside_definition(refs: DataFrame, attributed: DataFrame) -> DataFrame:
    return refs.join(attributed.select("ref_id"), "ref_id", "left_anti")


def documents_without_attribution(refs: DataFrame, attributed: DataFrame) -> DataFrame:
    """path: documents with references of which none lies in a definition."""
    inside = refs.join(attributed.select("ref_id"), "ref_id", "left_semi").select("path").distinct()
    return refs.select("path").distinct().join(inside, "path", "left_anti")


def first_definition(occ: DataFrame) -> DataFrame:
    """symbol, path, line, character of each symbol's first definition in document order."""
    defs = drop_locals(occ).where(is_definition(F.col("roles")))
    best = defs.groupBy("symbol").agg(F.min(F.struct("pos", "path", "line", "character")).alias("x"))
    return best.select("symbol", "x.path", "x.line", "x.character")


def numbered(df: DataFrame, keys: list[str], bucket: list[Column], order: list[str], name: str) -> DataFrame:
    """Adds `name`: 1, 2, … within `keys`, by `bucket` and then by `order`. Rows are numbered within a bucket, and a
    running sum over a key's buckets, one row each, gives the bucket's offset: one huge key is dealt to many tasks."""
    cell = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[b.alias(f"b{i}") for i, b in enumerate(bucket)])
    dealt = df.withColumn("_cell", cell)
    sizes = dealt.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*[F.col("_cell")[f"k{i}"] for i in range(len(keys))]).orderBy("_cell")
    before = sizes.select("_cell", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_cell").orderBy(*order))
    return dealt.withColumn("_own", own).join(before, "_cell").withColumn(name, F.col("_own") + F.col("_before")).drop("_cell", "_own", "_before")


def number_sites(site: DataFrame) -> DataFrame:
    """Adds `ordinal`: 1, 2, … per caller by file, line, column and target."""
    lines = [F.col("file"), F.floor(F.col("line") / BUCKET_LINES)]
    out = numbered(site, ["caller"], lines, ["line", "col", "declared_target", "site_id"], "ordinal")
    return out.withColumn("ordinal", F.col("ordinal").cast("int"))


def _offsets(counts: DataFrame, key: str) -> DataFrame:
    """key, n → key, offset: the sum of n over smaller keys. Keys are dealt by range and written; a task sums its own
    range, and a running sum over one row per task gives where it starts."""
    ranged = checkpointed(counts.repartitionByRange(key).withColumn("part", F.spark_partition_id()))
    tasks = ranged.groupBy("part").agg(F.sum("n").alias("task_n"))
    starts = tasks.select("part", (F.sum("task_n").over(Window.orderBy("part")) - F.col("task_n")).alias("start"))
    own = F.sum("n").over(Window.partitionBy("part").orderBy(key)) - F.col("n")
    return ranged.withColumn("own", own).join(F.broadcast(starts), "part").select(key, (F.col("own") + F.col("start")).alias("offset"))


def assign_ids(df: DataFrame, base: int, file: str, order: list[str], name: str = "new_id") -> DataFrame:
    """Consecutive ids from base + 1 by file, then by `order`, whose first column is a line number. Rows are numbered
    within their file, and a file's offset is added."""
    offsets = _offsets(df.groupBy(file).agg(F.count(F.lit(1)).alias("n")), file)
    own = numbered(df, [file], [F.floor(F.col(order[0]) / BUCKET_LINES)], order, "own")
    return own.join(offsets, file).withColumn(name, F.col("own") + F.col("offset") + base).drop("own", "offset")


def edges_without_occurrence(edges: DataFrame, occ: DataFrame) -> DataFrame:
    """Edges (path, line, character) at which no occurrence starts."""
    return edges.join(occ.select("path", "line", "character").distinct(), ["path", "line", "character"], "left_anti")


def unresolved_sites(sites: DataFrame, occ: DataFrame) -> DataFrame:
    """Adds `reason` to name sites: no-occurrence, unnamed-local (only locals that the document never defines), or null."""
    local = F.col("symbol").startswith(LOCAL)
    defined = occ.where(local & is_definition(F.col("roles"))).select("path", "symbol").distinct().withColumn("defined", F.lit(True))
    named = occ.join(defined, ["path", "symbol"], "left").groupBy("path", "line", "character").agg(F.bool_or(~local | F.col("defined").isNotNull()).alias("named"))
    reason = F.when(F.col("named").isNull(), "no-occurrence").when(~F.col("named"), "unnamed-local")
    return sites.join(named, ["path", "line", "character"], "left").withColumn("reason", reason).drop("named")
