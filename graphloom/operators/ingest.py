"""The whole analysis of an index: symbols, call sites, skipped references and name collisions of its documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import symbols as sym
from graphloom.functions import text as txt
from graphloom.functions.frames import checkpointed
from graphloom.operators import attribution as att
from graphloom.operators import names as nam
from graphloom.sources.readers import BadInput

RANGE = "struct<start_line:int, start_character:int, end_line:int, end_character:int>"


def _valid(raw: Column) -> Column:
    """Bytes as text; null where they cut a character."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))


def add_source_facts(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """refs: path, r (characters in bytes), open, and bucket, by which they lie (see att.add_innermost); sources: path, text.
    Adds is_name (null: the range isn't in the file) and called to open references; both are null for others. Most are told
    by their own line, which comes with the lines of their bucket; the file's text travels only to those that go on after
    it."""
    start = F.col("r.start_line")
    lines = sources.select("path", F.posexplode(F.split("text", "\n")).alias("line", "text")).groupBy("path", F.floor(F.col("line") / att.BUCKET_LINES).alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("lines"))
    own = refs.join(lines, ["path", "bucket"], "left").withColumn("text", F.when(F.col("open"), F.get("lines", (start - F.col("bucket") * att.BUCKET_LINES).cast("int"))["text"])).drop("lines", "bucket")
    raw, end = F.col("text").cast("binary"), F.col("r.end_character")
    own = own.withColumn("span", _valid(F.substring(raw, F.col("r.start_character") + 1, end - F.col("r.start_character")))).withColumn("rest", F.trim(F.translate(_valid(F.substring(raw, end + 1, F.length(raw))), "\r\t", "  ")))
    near = F.col("text").isNull() | ((F.col("r.end_line") == start) & (end <= F.length(raw)) & (F.col("rest") != "") & ~F.col("rest").startswith("::"))
    own = own.withColumn("far", F.col("open") & ~F.coalesce(near, F.lit(False)))
    own = own.withColumn("is_name", F.when(F.col("open"), txt.is_name(F.col("span"), F.lit(0), F.length("span")))).withColumn("called", F.when(F.col("open"), F.coalesce(F.col("rest").startswith("("), F.lit(False))))
    own = checkpointed(own.drop("open", "text", "span", "rest"))
    far = own.where("far")
    if far.isEmpty():
        return own.drop("far")
    sources = sources.join(far.select("path").distinct(), "path", "left_semi")
    at = txt.line_offsets(sources).select("path", "line", "offset")
    far = far.withColumn("start_line", start).withColumn("end_line", F.col("r.end_line")).join(at.toDF("path", "start_line", "start"), ["path", "start_line"], "left").join(at.toDF("path", "end_line", "end"), ["path", "end_line"], "left").join(sources, "path")
    start, end = (F.col("start") + F.col("r.start_character")).cast("int"), (F.col("end") + F.col("r.end_character")).cast("int")
    inside = (start <= end) & (end <= F.length(raw))
    span, after = (F.when(inside, _valid(x)) for x in (F.substring(raw, start + 1, end - start), F.substring(raw, end + 1, F.length(raw))))
    told = far.withColumn("is_name", txt.is_name(span, F.lit(0), F.length(span))).withColumn("called", F.coalesce(txt.is_called(after), F.lit(False)))
    return own.where("NOT far").drop("far").unionByName(told.select(*own.drop("far").columns))


def ranges_in_bytes(occ: DataFrame, sources: DataFrame) -> DataFrame:
    """Occurrences whose characters count UTF-16 units, with ranges in bytes as the analysis takes them. A place that isn't
    one of its line's stays as it is. Each place meets its own line, so files of any size are dealt to many tasks."""
    columns, key = ("range", "enclosing_range"), ["path", "doc_pos", "pos"]
    whole = lambda c: F.when(F.size(c) == 3, F.array(F.get(c, 0), F.get(c, 1), F.get(c, 0), F.get(c, 2))).when(F.size(c) == 4, F.col(c))
    ends = F.array(*[F.struct(F.lit(f"{c}{n}").alias("end"), F.get(whole(c), n).alias("line"), F.get(whole(c), n + 1).alias("column")) for c in columns for n in (0, 2)])
    places = occ.select(*key, F.explode(ends).alias("e")).select(*key, "e.*").where("line IS NOT NULL")
    met = places.join(txt.line_offsets(sources).drop("offset"), ["path", "line"], "left")
    met = met.withColumn("column", F.coalesce(txt.byte_in_line(F.col("text"), F.col("column"), "utf-16").cast("int"), "column"))
    found = met.groupBy(*key).agg(*[F.first(F.when(F.col("end") == f"{c}{n}", F.array("line", "column")), ignorenulls=True).alias(f"{c}{n}") for c in columns for n in (0, 2)])
    made = {c: F.when(F.col(f"{c}0").isNotNull(), F.concat(f"{c}0", f"{c}2")).otherwise(F.col(c)) for c in columns}
    return occ.join(found, key, "left").select(*[made.get(c, F.col(c)).alias(c) for c in occ.columns])


def usable(p: Column) -> Column:
    """Whether a symbol is global: neither a local nor a parameter."""
    return p["local"].isNull() & ~F.exists(p["descriptors"], lambda d: d["suffix"] == "parameter")


def definitions(occ: DataFrame, info: DataFrame, parsed: DataFrame) -> DataFrame:
    """symbol, file, kind, start_line, end_line of defined symbols. A definition's lines are those of its enclosing range,
    else its own."""
    known = parsed.where(usable(F.col("parsed"))).select("symbol")
    order = F.struct("doc_pos", "pos").alias("pos")
    extent = att.decode_range(F.lit(None).cast(RANGE), F.coalesce("enclosing_range", "range"))
    defs = occ.where(att.is_definition(F.col("roles"))).join(known, "symbol", "left_semi").select("symbol", order, "path", extent.alias("r")).select("symbol", "pos", "path", "r.start_line", "r.end_line")
    return nam.merge_definitions(info.join(known, "symbol", "left_semi").select("symbol", order, "path", "kind"), defs)


def described_symbols(defined: DataFrame, targets: DataFrame, parsed: DataFrame) -> DataFrame:
    """What `symbol_table` tells of each defined or targeted symbol by itself: symbol, base (null: no canonical name),
    class, kind, file, start_line, end_line, modules, manager, package."""
    p = F.col("parsed")
    rows = nam.union_symbols(defined, targets).join(defined, "symbol", "left").join(parsed, "symbol")
    return rows.select("symbol", sym.canonical_name(p).alias("base"), sym.namespace_class(p, F.col("kind")).alias("class"), sym.symbol_kind(p, F.col("kind")).alias("kind"), "file", "start_line", "end_line", sym.module_ancestors(p).alias("modules"), p["manager"].alias("manager"), p["package"].alias("package"))


def named_symbols(described: DataFrame, defined: DataFrame, parsed: DataFrame) -> DataFrame:
    """`symbol_table` of `described_symbols`, which are read more than once."""
    p = F.col("parsed")
    named = nam.assign_names(described.where("base IS NOT NULL"))
    own = defined.select("symbol").join(parsed, "symbol").select(p["manager"].alias("manager"), p["package"].alias("package"))
    return nam.is_external(named, own).select("symbol", "name", "kind", "file", "start_line", "end_line", "modules", "package", "external")


def symbol_table(defined: DataFrame, targets: DataFrame, parsed: DataFrame) -> DataFrame:
    """symbol, name, kind, file, start_line, end_line, modules, package, external of defined and targeted symbols that have
    a canonical name. defined: `definitions`; targets: symbol; parsed: symbol, parsed."""
    return named_symbols(described_symbols(defined, targets, parsed), defined, parsed)


class Symbols:
    """What an index says of its symbols: parsed (symbol, parsed), defined (`definitions`) and facts, which judge
    references: symbol, usable, callable, container (module or impl block), macro, dispatch. A symbol that can't be parsed
    fails."""

    def __init__(self, occ: DataFrame, info: DataFrame):
        self.parsed = checkpointed(sym.parse_distinct(occ.select("symbol").union(info.select("symbol")).where("symbol IS NOT NULL").distinct()))
        if (bad := sym.malformed(self.parsed).first()) is not None:
            raise BadInput(f"{bad['symbol']}: {bad['error']}")
        self.defined = checkpointed(definitions(occ, info, self.parsed))
        p, kind = F.col("parsed"), F.col("kind")
        facts = self.parsed.join(self.defined.select("symbol", "kind"), "symbol", "left")
        self.facts = checkpointed(facts.select("symbol", usable(p).alias("usable"), sym.is_callable(p, kind).alias("callable"), (sym.is_module(p, kind) | sym.is_impl_block(p)).alias("container"), sym.is_macro(p, kind).alias("macro"), sym.dispatch_class(p).alias("dispatch")))


#: What judged occurrences carry of their symbols' facts.
CARRIED = ("usable", "callable", "macro", "dispatch")


def judge(occ: DataFrame, facts: DataFrame, sources: DataFrame) -> DataFrame:
    """path, doc_pos, pos, symbol, r (the range), roles, caller, is_name and called of each occurrence, and what is CARRIED
    of its symbol: all that depends on its file's text and ranges. References go to the innermost definition at their start
    that is neither a module nor an impl block. Occurrences are dealt by symbol once and by file and bucket of lines once,
    where they meet definitions and lines alike."""
    decoded = lambda c: att.decode_range(F.lit(None).cast(RANGE), F.col(c)).alias("r")
    definition = att.is_definition(F.col("roles"))
    rows = occ.join(facts.select("symbol", *CARRIED), "symbol").select("path", "doc_pos", "pos", "symbol", decoded("range"), "roles", *CARRIED, F.coalesce(F.col("usable") & ~definition, F.lit(False)).alias("open"))
    callers = occ.where(definition & F.col("enclosing_range").isNotNull()).select("path", "symbol", decoded("enclosing_range")).join(facts.where("usable AND NOT container").select("symbol"), "symbol").select("path", "symbol", "r.*")
    return add_source_facts(att.add_innermost(rows, callers, ["doc_pos", "pos"]), sources)


def conclude(judged: DataFrame, symbols: Symbols) -> dict[str, DataFrame]:
    """symbols, sites, skipped (reason, n) and collisions of judged occurrences, which are read more than once."""
    reason = att.skip_reason(F.when(F.col("usable"), F.col("symbol")).otherwise(att.LOCAL), F.col("roles"), F.col("is_name"), F.col("callable"), F.col("caller").isNotNull())
    rows = judged.withColumn("reason", reason)
    place = [F.col("path").alias("file"), (F.col("r.start_line") + 1).alias("line"), (F.col("r.start_character") + 1).alias("col")]
    sites = rows.where("reason IS NULL").select(F.struct("path", "doc_pos", "pos").alias("site_id"), "caller", *place, sym.ref_kind(F.col("macro"), F.col("called")).alias("ref_kind"), F.col("symbol").alias("declared_target"), "dispatch")
    table = symbol_table(symbols.defined, sites.select(F.col("declared_target").alias("symbol")), symbols.parsed)
    return {"symbols": table, "sites": att.number_sites(sites).drop("site_id"), "skipped": att.skip_counts(rows), "collisions": nam.name_collisions(table)}


def analyze(occ: DataFrame, info: DataFrame, sources: DataFrame) -> dict[str, DataFrame]:
    """symbols, sites, skipped (reason, n) and collisions of a flattened index and its files' texts.

    occ: path, doc_pos, pos, symbol, range, enclosing_range, roles; info: path, doc_pos, pos, symbol, kind; sources: path,
    text. Lines and columns of sites count from 1. A symbol that can't be parsed fails the analysis."""
    symbols = Symbols(occ, info)
    return conclude(judge(occ, symbols.facts, sources), symbols)


def file_states(occ: DataFrame, files: DataFrame) -> DataFrame:
    """path, content_hash and a digest of the file's occurrences, whatever their order; files: path, content_hash."""
    sized = lambda c: (F.coalesce(F.size(c), F.lit(-1)), F.col(c))
    row = F.xxhash64("doc_pos", "pos", "symbol", *sized("range"), *sized("enclosing_range"), "roles")
    per_file = occ.groupBy("path").agg(F.count(F.lit(1)).alias("occurrences"), F.bit_xor(row).alias("digest"))
    return files.select("path", "content_hash").join(per_file, "path", "left")


#: Tables that a generation keeps for the next one, besides those of its schema.
STATE = ("judged", "fact", "file_state")


def generation(occ: DataFrame, info: DataFrame, sources, files: DataFrame, run: DataFrame, source: str, previous: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """All tables of a generation, ready for publish_generation(), of an index, its files' texts, their file table (path,
    language, content_hash, size) and the run (one row: run_id, provider, provider_version, args, started_at, finished_at,
    status).

    With the `previous` generation's tables only some files are judged anew: those whose content or occurrences changed,
    and those with an occurrence of a symbol of which other facts hold now. The rows of the others are carried forward, and
    a site that stays where it was keeps its id. The tables equal those of a generation without a previous one, but for the
    ids. `sources` may be a function that reads the texts of a table of paths (see readers.source_texts): then no others
    are read."""
    symbols = Symbols(occ, info)
    states = checkpointed(file_states(occ, files))
    if previous is None:
        judged = judge(occ, symbols.facts, sources(states.select("path")) if callable(sources) else sources)
    else:
        names, same = symbols.facts.columns[1:], lambda c: F.col(f"now.{c}").eqNullSafe(F.col(f"was.{c}"))
        known = states.alias("now").join(previous["file_state"].alias("was"), "path").where(same("content_hash") & same("occurrences") & same("digest")).select("path")
        pairs = symbols.facts.alias("now").join(previous["fact"].alias("was"), "symbol")
        other = pairs.where(~F.forall(F.array(*map(same, names)), lambda x: x)).select("symbol")
        touched = occ.join(other, "symbol", "left_semi").select("path").distinct()
        kept = checkpointed(known.join(touched, "path", "left_anti"))
        fresh = lambda df: df.join(kept, "path", "left_anti")
        texts = sources(fresh(states.select("path"))) if callable(sources) else fresh(sources)
        before = previous["judged"]
        if "callable" not in before.columns:  # of a generation whose judged occurrences carried no facts
            before = before.join(previous["fact"].select("symbol", *CARRIED), "symbol")
        judged = before.join(kept, "path", "left_semi").unionByName(judge(fresh(occ), symbols.facts, texts))
        judged = checkpointed(judged)
    found = conclude(judged, symbols)
    run_id = run.first()["run_id"]
    told = checkpointed(found["sites"])  # symbols and ids alike are told by it, without judging anew
    described = checkpointed(described_symbols(symbols.defined, told.select(F.col("declared_target").alias("symbol")), symbols.parsed))
    table = named_symbols(described, symbols.defined, symbols.parsed)
    sites = with_ids(told, previous["call_site"] if previous else None)
    call_site = sites.select("site_id", F.lit(run_id).cast("int").alias("run_id"), "caller", "file", F.col("line").cast("int").alias("line"), F.col("col").cast("int").alias("col"), "ordinal", "ref_kind", F.lit(None).cast("string").alias("receiver_text"), "declared_target", "dispatch", F.lit(source).alias("source"))
    call_site = checkpointed(call_site)
    language = files.select(F.col("path").alias("file"), F.col("language").alias("lang"))
    symbol = table.join(language, "file", "left").select(F.col("symbol").alias("id"), "name", "lang", "kind", "file", "start_line", "end_line", F.lit(None).cast("string").alias("signature"), F.try_element_at("modules", F.lit(-1)).alias("module"), "modules", "package", "external")
    counts = call_site.groupBy(F.col("file").alias("path")).agg(F.count(F.lit(1)).alias("edge_count"))
    run_file = files.select("path").join(counts, "path", "left").select(F.lit(run_id).cast("int").alias("run_id"), "path", F.coalesce("edge_count", F.lit(0)).cast("long").alias("edge_count"))
    return {
        "run": run, "run_file": run_file, "file": files.select("path", "language", "content_hash", "size"), "symbol": symbol, "call_site": call_site, "call_target": call_site.select("site_id", F.col("declared_target").alias("target"), F.lit("declared").alias("method")),
        "judged": judged, "fact": symbols.facts, "file_state": states,
    }


def with_ids(sites: DataFrame, previous: DataFrame | None) -> DataFrame:
    """sites with site_id: that of the previous site of the same caller, place and target, or else consecutive ones above
    all that were given."""
    key, order = ["caller", "file", "line", "col", "declared_target"], ["line", "col", "declared_target", "caller"]
    if previous is None:
        return att.assign_ids(sites, 0, "file", order, "site_id")
    old = checkpointed(sites.join(previous.groupBy(*key).agg(F.min("site_id").alias("site_id")), key, "left"))
    top = previous.agg(F.max("site_id")).first()[0] or 0
    new = att.assign_ids(old.where("site_id IS NULL").drop("site_id"), top, "file", order, "site_id")
    return old.where("site_id IS NOT NULL").unionByName(new)


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """files, symbols, sites and collisions of a generation's tables, in one row."""
    n = lambda df, c: df.select(F.count(F.lit(1)).alias(c))
    names = tables["symbol"].groupBy("name").count().where("count > 1")
    parts = [n(tables["file"], "files"), n(tables["symbol"], "symbols"), n(tables["call_site"], "sites"), n(names, "collisions")]
    rows = [p.select(F.lit(p.columns[0]).alias("what"), F.col(p.columns[0]).alias("n")) for p in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).groupBy().pivot("what", [p.columns[0] for p in parts]).sum("n")
