"""Views of the call graph and operations on tag tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.frames import checkpointed
from graphloom.operators.changes import ancestors
from graphloom.operators.folds import decayed_counts

EXPANSION = "lsp-impl"


def derive_facets(file: DataFrame, symbol: DataFrame, site: DataFrame) -> DataFrame:
    """item, key, value of files (lang, dir), symbols (kind, module, file) and sites (caller, target, dispatch)."""
    f = F.concat(F.lit("file:"), "path")
    parts = [
        file.select(f.alias("item"), F.lit("lang").alias("key"), F.col("language").alias("value")),
        file.select(f.alias("item"), F.lit("dir").alias("key"), F.explode(ancestors(F.col("path"))).alias("value")),
    ]
    melt = lambda df, item, columns: df.select(item.alias("item"), F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in columns])).alias("x")).select("item", "x.key", "x.value")
    parts.append(melt(symbol, F.concat(F.lit("sym:"), "id"), [("kind", "kind"), ("module", "module"), ("file", "file")]))
    parts.append(melt(site, F.concat(F.lit("site:"), F.col("site_id").cast("string")), [("caller", "caller"), ("target", "declared_target"), ("dispatch", "dispatch")]))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where("value IS NOT NULL")


def derive_call_facets(site: DataFrame, target: DataFrame, symbol: DataFrame) -> DataFrame:
    """item, key, value of what calls tell, beside derive_facets: for symbols, calls (each distinct target of their sites,
    expansions included) and each of their `modules` where they have such a list; for sites, kind, line, file, the caller's
    module, target (each), prov:source and prov:method. Rows of sites are dealt by site once, where they meet their targets
    and repeats are dropped; only pairs of a caller and a target are dealt anew."""
    has = lambda c: F.col(c) if c in site.columns else F.lit(None).cast("string")
    modules = symbol.select(F.col("id").alias("caller"), F.col("module").alias("_module"))
    rows = site.join(modules, "caller", "left").select("site_id", "caller", F.col("line").cast("string").alias("line"), "file", "_module", has("source").alias("source")).repartition("site_id")
    pairs = lambda *kv: F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in kv])).alias("x")
    each = lambda df, *kv: df.select("site_id", pairs(*kv)).select("site_id", "x.*").where("value IS NOT NULL").distinct().select(F.concat(F.lit("site:"), F.col("site_id").cast("string")).alias("item"), "key", "value")
    own = each(rows, ("kind", F.lit("callsite")), ("line", F.col("line")), ("file", F.col("file")), ("module", F.col("_module")), ("prov:source", F.col("source")))
    met = rows.join(target.select("site_id", "target", "method"), "site_id")
    calls = met.select("caller", "target").where("target IS NOT NULL").distinct().select(F.concat(F.lit("sym:"), "caller").alias("item"), F.lit("calls").alias("key"), F.col("target").alias("value"))
    out = own.unionByName(each(met, ("target", F.col("target")), ("prov:method", F.col("method")))).unionByName(calls)
    if "modules" in symbol.columns:
        listed = symbol.select(F.concat(F.lit("sym:"), "id").alias("item"), F.lit("modules").alias("key"), F.explode("modules").alias("value"))
        out = out.unionByName(listed.where("value IS NOT NULL").distinct())
    return out


def call_edges(site: DataFrame, target: DataFrame, symbol: DataFrame) -> DataFrame:
    """site_id, from_module, to_module, caller, target, method for each target of each site."""
    modules = symbol.select("id", "module")
    rows = site.select("site_id", "caller").join(target, "site_id")
    return rows.join(modules.toDF("caller", "from_module"), "caller").join(modules.toDF("target", "to_module"), "target")


def module_edges(edges: DataFrame) -> DataFrame:
    """from_module, to_module, calls: a site counts once for each other module that it reaches."""
    return edges.where("from_module <> to_module").select("site_id", "from_module", "to_module").distinct().groupBy("from_module", "to_module").agg(F.count(F.lit(1)).alias("calls"))


def module_drilldown(edges: DataFrame, module: str) -> DataFrame:
    """source, sink, calls, expansion_only: edges of the module's symbols; ends outside it show as their module."""
    end = lambda name, mod: F.when(F.col(mod) == module, F.col(name)).otherwise(F.col(mod))
    near = edges.where((F.col("from_module") == module) | (F.col("to_module") == module))
    return near.select(end("caller", "from_module").alias("source"), end("target", "to_module").alias("sink"), "site_id", "method").groupBy("source", "sink").agg(F.countDistinct("site_id").alias("calls"), F.bool_and(F.col("method") == EXPANSION).alias("expansion_only"))


def collapse_modules(module_graph: DataFrame, depth: int) -> DataFrame:
    """Module names cut to `depth` parts, with calls summed and new self-loops dropped."""
    cut = lambda c: F.substring_index(c, ".", depth)
    return module_graph.groupBy(cut("from_module").alias("from_module"), cut("to_module").alias("to_module")).agg(F.sum("calls").alias("calls")).where("from_module <> to_module")


def result_set_callgraph(edges: DataFrame, items: DataFrame) -> DataFrame:
    """S4's rows for the symbols (id) of a result set: both ends inside show by name, others by module."""
    inside = items.select("id").distinct()
    rows = edges.join(inside.select(F.col("id").alias("caller"), F.lit(True).alias("c")), "caller", "left").join(inside.select(F.col("id").alias("target"), F.lit(True).alias("t")), "target", "left")
    rows = rows.where("c OR t").select(F.when(F.col("c"), F.col("caller")).otherwise(F.col("from_module")).alias("source"), F.when(F.col("t"), F.col("target")).otherwise(F.col("to_module")).alias("sink"), "site_id")
    return rows.groupBy("source", "sink").agg(F.countDistinct("site_id").alias("calls"))


def heaviest_edges(module_graph: DataFrame, most: int) -> DataFrame:
    """The `most` edges of most calls; at ties the smaller (from, to) stays. Top-k, never a full sort in one task."""
    return module_graph.orderBy(F.desc("calls"), "from_module", "to_module").limit(most)


def elided_edges(module_graph: DataFrame, most: int) -> DataFrame:
    """One row: how many edges and calls the cut leaves out."""
    kept = heaviest_edges(module_graph, most).agg(F.count(F.lit(1)).alias("e"), F.sum("calls").alias("c"))
    total = module_graph.agg(F.count(F.lit(1)).alias("te"), F.sum("calls").alias("tc"))
    return total.join(kept, F.lit(True)).select((F.col("te") - F.col("e")).alias("edges"), (F.coalesce("tc", F.lit(0)) - F.coalesce("c", F.lit(0))).alias("calls"))  # one row each


def skeleton_rows(symbol: DataFrame, site: DataFrame, target: DataFrame) -> DataFrame:
    """file, caller, ordinal, line, target, also: symbols' call sites in order; targets after a site's first are `also`."""
    own = Window.partitionBy("site_id").orderBy("target", "method")
    order = Window.partitionBy("caller").orderBy("line", "col", "site_id")
    numbered = site.join(symbol.select(F.col("id").alias("caller")), "caller", "left_semi").withColumn("ordinal", F.row_number().over(order))
    named = target.withColumn("also", F.row_number().over(own) > 1)
    return numbered.select("site_id", "file", "caller", "ordinal", "line").join(named.select("site_id", "target", "also"), "site_id", "left").withColumn("also", F.coalesce("also", F.lit(False)))


def symbol_card(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """id, direction (calls, called-by), other, sites."""
    pairs = edges.groupBy("caller", "target").agg(F.countDistinct("site_id").alias("sites"))
    out = pairs.select(F.col("caller").alias("id"), F.lit("calls").alias("direction"), F.col("target").alias("other"), "sites")
    back = pairs.select(F.col("target").alias("id"), F.lit("called-by").alias("direction"), F.col("caller").alias("other"), "sites")
    return out.union(back).join(ids.select("id").distinct(), "id", "left_semi")


def site_card(site: DataFrame, target: DataFrame, ids: DataFrame) -> DataFrame:
    """site_id, caller, declared_target, target, method: all targets of the sites in ids; null target: it has none."""
    some = site.join(ids.select("site_id").distinct(), "site_id", "left_semi").select("site_id", "caller", "declared_target")
    return some.join(target.select("site_id", "target", "method"), "site_id", "left")


def orphan_tags(tags: DataFrame, items: DataFrame) -> DataFrame:
    return tags.join(items.select("item").distinct(), "item", "left_anti")


#: Lines of a tag file that are put in order in one task.
LINES = 4096


def line_before(lines: DataFrame) -> DataFrame:
    """lines with `previous`, the item of the entry before, whatever its number. Ranges of LINES numbers are ordered on
    their own, and each range's last entry is handed to the next range that has one."""
    rows = lines.withColumn("_range", F.floor(F.col("line_no") / LINES))
    last = rows.groupBy("_range").agg(F.max_by("item", "line_no").alias("_last"))
    handed = last.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_handed"))  # a row per range
    within = F.lag("item").over(Window.partitionBy("_range").orderBy("line_no"))
    return rows.withColumn("_previous", within).join(handed, "_range").withColumn("previous", F.coalesce("_previous", "_handed")).drop("_range", "_previous", "_handed")


def check_tags(lines: DataFrame, items: DataFrame, reserved: tuple[str, ...] = ("kind", "lang", "file")) -> DataFrame:
    """line_no, violation of the entries of a tag file (line_no, item, tags); lines without an entry have no row. `items`
    are those that exist. Violations of a line by itself: bad-kind, symbol-item, bad-path (not normalised), no-tags,
    bad-tag, bad-value, reserved-key, duplicate-tag, tags-unsorted; of a line among others: duplicate-item (with the first
    line), unsorted (less than the entry before), orphan."""
    item, tags = F.col("item"), F.coalesce("tags", F.expr("cast(array() as array<string>)"))
    path, key = F.regexp_replace(item, "^file:", ""), lambda t: F.substring_index(t, "=", 1)
    is_file = item.startswith("file:")
    one = lambda test, text: F.when(test, F.array(F.lit(text))).otherwise(F.expr("cast(array() as array<string>)"))
    each = lambda test, name, of: F.transform(F.filter(F.array_distinct(tags), test), lambda t: F.concat(F.lit(name + " "), of(t)))
    own = F.concat(
        one(~is_file & ~item.startswith("sym:"), "bad-kind"), one(item.startswith("sym:"), "symbol-item"), one(is_file & path.rlike(r"^$|^/|/$|//|(^|/)\.\.?(/|$)"), "bad-path"), one(F.size(tags) == 0, "no-tags"),
        each(lambda t: ~t.rlike(r"^[\w:.-]+(=.*)?$"), "bad-tag", lambda t: t), each(lambda t: t.rlike("^[^=]*=.*/"), "bad-value", lambda t: t), F.array_distinct(each(lambda t: key(t).isin(*reserved), "reserved-key", key)),
        F.transform(F.filter(F.array_distinct(tags), lambda t: F.size(F.filter(tags, lambda u: u == t)) > 1), lambda t: F.concat(F.lit("duplicate-tag "), t)), one(tags != F.array_sort(tags), "tags-unsorted"),
    )
    out = lines.select("line_no", F.explode(own).alias("violation"))
    first = lines.groupBy("item").agg(F.min("line_no").alias("first"))
    out = out.union(lines.join(first, "item").where("line_no > first").select("line_no", F.concat(F.lit("duplicate-item of line "), F.col("first").cast("string")).alias("violation")))
    out = out.union(line_before(lines).where("item < previous").select("line_no", F.lit("unsorted").alias("violation")))
    return out.union(orphan_tags(lines, items).select("line_no", F.lit("orphan").alias("violation")))


def apply_tag_ops(tags: DataFrame, ops: DataFrame) -> DataFrame:
    """tags (item, tag) after ops (op: tag, untag, mv; item, arg). mv renames an item, or a directory with all below."""
    added = ops.where("op = 'tag'").select("item", F.col("arg").alias("tag"))
    removed = ops.where("op = 'untag'").select("item", F.col("arg").alias("tag"))
    now = tags.select("item", "tag").union(added).distinct().join(removed, ["item", "tag"], "left_anti")
    moves = ops.where("op = 'mv'").select(F.col("item").alias("old"), F.col("arg").alias("new"))
    heads = F.array_append(ancestors(F.col("item")), F.col("item"))
    touched = now.select("item", "tag", F.explode(heads).alias("old")).join(moves, "old")
    longest = touched.groupBy("item", "tag").agg(F.max(F.struct(F.length("old").alias("n"), "old", "new")).alias("m"))
    moved = now.join(longest, ["item", "tag"], "left")
    item = F.when(F.col("m").isNotNull(), F.concat("m.new", F.substring(F.col("item"), F.col("m.n") + 1, F.length("item")))).otherwise(F.col("item"))
    return moved.select(item.alias("item"), "tag").distinct()


def merge_tags(base: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """item, tags, conflict: three-way merge of tag sets per item. Only two different changes of one item conflict."""
    sets = lambda df, c: df.groupBy("item").agg(F.sort_array(F.collect_set("tag")).alias(c))
    rows = sets(base, "b").join(sets(left, "l"), "item", "full").join(sets(right, "r"), "item", "full")
    none = F.expr("cast(array() as array<string>)")
    b, x, y = (F.coalesce(c, none) for c in ("b", "l", "r"))
    conflict = (x != b) & (y != b) & (x != y)
    return rows.select("item", F.when(conflict, none).when(x != b, x).otherwise(y).alias("tags"), conflict.alias("conflict")).where((F.size("tags") > 0) | F.col("conflict"))


#: Symbols and sites of one simple name that meet in one tile; of more, each is dealt to several. Symbols of one list.
NAME_TILE, SITE_TILE, LIST = 16_384, 8192, 1024
#: Name matches that a task gives, about, and the most tasks.
TASK_MATCHES, MOST_TASKS = 8_000_000, 20_000


def name_candidates(named: DataFrame, symbol: DataFrame) -> DataFrame:
    """site_id, name, candidates: how many symbols have an unresolved name (site_id, name) as their simple name. Counted in
    an index of names, without a row for each candidate."""
    index = simple_names(symbol).groupBy("name").agg(F.count(F.lit(1)).alias("candidates"))
    return named.select("site_id", "name").distinct().join(index, "name").select("site_id", "name", "candidates")


def simple_names(symbol: DataFrame) -> DataFrame:
    return symbol.select(F.col("id").alias("target"), F.element_at(F.split("name", r"\."), -1).alias("name")).distinct()


def name_matches(named: DataFrame, symbol: DataFrame) -> DataFrame:
    """site_id, target, candidates: each unresolved name with all symbols of that simple name. Symbols and sites of a name
    meet in tiles of NAME_TILE by SITE_TILE, so a name with very many of both is dealt to many tasks. A tile's symbols are
    lists, which each of its sites spreads. Tasks are as many as the matches ask for, not as the few bytes of the tiles. The
    lists' copies, one for each SITE_TILE sites, are dealt as the sites are and never broadcast: Spark would judge them by
    what they were before they were copied."""
    own, sites = simple_names(symbol), named.select("site_id", "name").distinct()
    rows = own.groupBy("name").agg(F.count(F.lit(1)).alias("candidates")).join(sites.groupBy("name").agg(F.count(F.lit(1)).alias("sites")), "name")
    tiles = checkpointed(rows.select("name", "candidates", "sites", F.ceil(F.col("candidates") / NAME_TILE).alias("across"), F.ceil(F.col("sites") / SITE_TILE).alias("down")))
    matches, most = tiles.agg(F.sum(F.col("candidates").cast("double") * F.col("sites")), F.sum(F.col("across") * F.col("down"))).first()
    tasks = max(int(symbol.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int((matches or 0) / TASK_MATCHES), most or 0, MOST_TASKS))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part, deal = F.pmod(F.xxhash64("target"), F.greatest("across", F.ceil(F.col("candidates") / LIST))), lambda df: df.repartition(tasks, "name", "x", "y")
    lists = own.join(tiles.select("name", "candidates", "across", "down"), "name").select("name", "target", "candidates", "across", "down", part.alias("part")).groupBy("name", "part", "candidates", "across", "down").agg(F.collect_list("target").alias("targets"))
    lists = deal(lists.select("name", "candidates", "targets", F.pmod("part", "across").alias("x"), each("down").alias("y")))
    sites = sites.join(tiles.select("name", "across", "down"), "name").select("name", "site_id", F.pmod(F.xxhash64("site_id"), "down").alias("y"), each("across").alias("x"))
    return deal(sites).join(lists.hint("merge"), ["name", "x", "y"]).select("site_id", F.explode("targets").alias("target"), "candidates")


def union_call_edges(site: DataFrame, position_edges: DataFrame, named: DataFrame, symbol: DataFrame) -> DataFrame:
    """site_id, target, method, candidates: edges by position (file, line, col, callee, method) become targets of the
    site there; unresolved names (site_id, name; one to a site) get every symbol of that simple name as a name-match. Edges
    by position are dealt by site once, where repeats are dropped and the rest is counted."""
    by_position = site.select("site_id", "file", "line", "col").join(position_edges, ["file", "line", "col"]).select("site_id", F.col("callee").alias("target"), "method").repartition("site_id").distinct()
    counted = by_position.withColumn("candidates", F.count(F.lit(1)).over(Window.partitionBy("site_id", "method")))
    return counted.unionByName(name_matches(named, symbol).withColumn("method", F.lit("name-match")))


def change_facets(batch: DataFrame) -> DataFrame:
    """item, key, value of a batch of changes (path, kind): the kind and the directories above each path."""
    item = F.concat(F.lit("file:"), "path")
    return batch.select(item.alias("item"), F.lit("change").alias("key"), F.col("kind").alias("value")).union(batch.select(item.alias("item"), F.lit("dir").alias("key"), F.explode(ancestors(F.col("path"))).alias("value")))


def guarded(ops: DataFrame, half_life: float, trip: float) -> DataFrame:
    """ops with c, the actor's count after each, and tripped: whether a count of `trip` has been reached since it was last
    under a quarter of that."""
    rows = decayed_counts(ops, half_life).withColumn("c", F.col("before") + 1)
    at = F.struct("ts", "op_id")
    so_far = Window.partitionBy("actor").orderBy("ts", "op_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tripped, cleared = F.max(F.when(F.col("c") >= trip, at)).over(so_far), F.max(F.when(F.col("before") < trip / 4, at)).over(so_far)
    return rows.withColumn("tripped", tripped.isNotNull() & (cleared.isNull() | (tripped >= cleared))).drop("before")


def decay_guard(ops: DataFrame, half_life: float, trip: float) -> DataFrame:
    """actor, ops, c, tripped after all of an actor's ops (actor, ts in seconds, op_id): each adds 1 to a count that halves
    every `half_life` seconds. The guard trips at a count of `trip` and clears where an op finds less than a quarter of it;
    it is tripped if it last tripped at or after it last cleared, so extremes tell it and no log is gathered."""
    at = F.struct("ts", "op_id")
    rows = decayed_counts(ops, half_life).withColumn("c", F.col("before") + 1)
    last = rows.groupBy("actor").agg(F.count(F.lit(1)).alias("ops"), F.max_by("c", at).alias("c"), F.max(F.when(F.col("c") >= trip, at)).alias("tripped_at"), F.max(F.when(F.col("before") < trip / 4, at)).alias("cleared_at"))
    return last.select("actor", "ops", "c", (F.col("tripped_at").isNotNull() & (F.col("cleared_at").isNull() | (F.col("tripped_at") >= F.col("cleared_at")))).alias("tripped"))
