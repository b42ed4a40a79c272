"""Registered queries over the driver's tables, and the SQL each must equal.

An entry is (query, SQL): the query takes `r`, which gives relations of `inputs` by name; the SQL names them as {name}.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.functions import symbols as sym
from graphloom.functions import text as txt
from graphloom.functions.frames import checkpointed
from graphloom.operators import attribution as att
from graphloom.operators import changes as chg
from graphloom.operators import expansion as exp
from graphloom.operators import facets as fac
from graphloom.operators import generations as gen
from graphloom.operators import graph_views as gv
from graphloom.operators import ingest as ing
from graphloom.operators import names as nam
from graphloom.operators import quality_checks as chk
from graphloom.operators import regressions as reg
from graphloom.operators import resolution as res
from graphloom.operators import sessions as ses
from graphloom.operators import syntax_context as syn
from graphloom.plans import change_streams, details, reports, round_trips, tag_files
from graphloom.plans.inputs import lines_once, lines_upto, oracle, relation
from graphloom.sources import snapshots

RESOLVED = "EXISTS (SELECT 1 FROM {call_target} t WHERE t.site_id = s.site_id AND t.method <> 'name-match')"
BY_MODULE = f"""SELECT f.language, y.package, y.module, count(*) AS call_sites, count(*) FILTER (WHERE {RESOLVED}) AS resolved, count(*) - count(*) FILTER (WHERE {RESOLVED}) AS unresolved
  FROM {{call_site}} s LEFT JOIN {{file}} f ON f.path = s.file LEFT JOIN {{symbol}} y ON y.id = s.caller GROUP BY f.language, y.package, y.module"""
BY_MODULE = BY_MODULE.replace(RESOLVED, "resolved").replace("{call_site} s", "(SELECT s.*, " + RESOLVED + " AS resolved FROM {call_site} s) s")


def by_module(r):
    return reports.by_module(lines_once(r))


def union_call_edges(r):
    r = lines_once(r)
    site = r("call_site")
    by_position = site.where("col % 2 = 0").select("file", "line", "col", F.col("declared_target").alias("callee"), F.lit("vta").alias("method")).distinct()
    named = site.where("col % 5 = 1").select("site_id", F.concat(F.lit("o"), F.col("line") * 7).alias("name"))
    return gv.union_call_edges(site, by_position, named, r("symbol"))


def year(r, y):
    return r("edges_by_year").where(F.col("generation") == y).drop("generation")


def files_of(r):
    return r("supplier").where("s_suppkey % 9 <> 4").select(F.concat(F.lit("src/s"), "s_suppkey", F.lit(".rs")).alias("path"))


DROPS = """SELECT p.provider, p.path, p.edge_count AS previous, c.edge_count AS current FROM (SELECT * FROM {edges_by_year} WHERE generation = 1997) p
  LEFT JOIN (SELECT * FROM {edges_by_year} WHERE generation = 1998) c ON c.provider = p.provider AND c.path = p.path
  LEFT JOIN (SELECT concat('src/s', s_suppkey, '.rs') AS path FROM {supplier} WHERE s_suppkey % 9 <> 4) x ON x.path = p.path
  WHERE CASE WHEN c.edge_count IS NOT NULL THEN CASE WHEN p.edge_count <= 0 THEN FALSE WHEN c.edge_count <= 0 THEN TRUE ELSE (p.edge_count - c.edge_count) * 100 > p.edge_count * 50 END ELSE p.edge_count > 0 AND x.path IS NOT NULL END"""
DIFFS = """SELECT coalesce(a.provider, b.provider) AS provider, coalesce(a.path, b.path) AS path, a.edge_count AS expected, b.edge_count AS found FROM (SELECT * FROM {edges_by_year} WHERE generation = 1997) a
  FULL JOIN (SELECT * FROM {edges_by_year} WHERE generation = 1998) b ON a.provider = b.provider AND a.path = b.path WHERE a.edge_count IS DISTINCT FROM b.edge_count"""


def drops(r):
    return reg.edge_regressions(year(r, 1997), year(r, 1998), files_of(r))


def diffs(r):
    return reg.edge_diff(year(r, 1997), year(r, 1998))


INNERMOST = """SELECT ref_id, caller FROM (SELECT r.ref_id, d.symbol AS caller, row_number() OVER (PARTITION BY r.ref_id ORDER BY start_line DESC, start_character DESC, end_line, end_character, d.symbol) AS n FROM {reference} r JOIN {definition} d ON r.path = d.path
  AND (d.start_line < r.line OR d.start_line = r.line AND d.start_character <= r.character) AND (r.line < d.end_line OR r.line = d.end_line AND r.character <= d.end_character)) WHERE n = 1"""


def innermost(r):
    return att.attribute_innermost(r("reference"), r("definition"))


REASON = """SELECT o.*, CASE WHEN symbol LIKE 'local %' THEN 'local' WHEN roles & 1 <> 0 THEN 'definition' WHEN NOT coalesce(is_name, TRUE) THEN 'operator' WHEN kind <> 'method' THEN 'non_callable' WHEN line > 5 THEN 'outside_definition' END AS reason FROM {occurrence} o"""


def reasons(r):
    inside = F.col("line") <= 5
    return r("occurrence").withColumn("reason", att.skip_reason(F.col("symbol"), F.col("roles"), F.col("is_name"), F.col("kind") == "method", inside))


def parsed(r):
    return sym.parse_symbols(r("symbol_string"))


#: The grammar of the relation's symbols, as SQL: local, or five fields whose last is namespace/Type#member.
PARSED = r"""SELECT symbol, n, symbol LIKE 'local %' AS is_local, starts_with(symbol, 'rust') AS rust, regexp_extract(replace(symbol, '`', ''), '1\.0 ([^/]*)/|\. (a/[^/]*)/', 0) AS lead_text,
  replace(regexp_replace(replace(symbol, '`', ''), '^(rust-analyzer cargo my-shop 1\.0 |scip-go gomod shop \. )', ''), '().', '') AS body, regexp_extract(symbol, '(\(\)\.|#|\.)$', 1) AS tail FROM {symbol_string}"""
CANON = r"SELECT symbol, n, CASE WHEN NOT is_local THEN concat(CASE WHEN rust THEN 'my_shop.' ELSE '' END, regexp_replace(regexp_replace(body, '[#.]$', ''), '[/#]', '.', 'g')) END AS name FROM (" + PARSED + ")"


def named(r):
    p = F.col("parsed")
    return parsed(r).select("symbol", "n", sym.canonical_name(p).alias("name"), sym.namespace_class(p, F.lit(None).cast("string")).alias("class"))


CLASSED = r"SELECT c.symbol, c.name AS base, CASE WHEN p.is_local THEN 'other' WHEN p.tail = '().' THEN 'fn' WHEN p.tail = '#' THEN 'type' ELSE 'const' END AS class FROM (SELECT DISTINCT symbol, name FROM (" + CANON + ")) c JOIN (SELECT DISTINCT symbol, is_local, tail FROM (" + PARSED + ")) p ON p.symbol = c.symbol"
ASSIGNED = "SELECT a.symbol, a.base, a.class, CASE WHEN least_rank < most_rank AND rank > least_rank THEN concat(base, '+', class) ELSE base END AS name FROM (SELECT *, min(rank) OVER (PARTITION BY base) AS least_rank, max(rank) OVER (PARTITION BY base) AS most_rank FROM (SELECT *, CASE class WHEN 'type' THEN 1 WHEN 'fn' THEN 2 WHEN 'const' THEN 3 END AS rank FROM (" + CLASSED + "))) a"


def assigned(r):
    return nam.assign_names(named(r).select("symbol", F.col("name").alias("base"), "class").distinct())


IMPLS = "SELECT concat('part:', p_partkey) AS method, concat('part:', p_partkey + p_size % 3) AS implementation FROM {part}"
EXPANDED = "SELECT DISTINCT s.site_id, i.implementation AS target, 'lsp-impl' AS method FROM {call_site} s JOIN (" + IMPLS + ") i ON i.method = s.declared_target AND i.method <> i.implementation JOIN {symbol} y ON y.id = i.implementation"


def impls(r):
    return r("part").select(F.concat(F.lit("part:"), "p_partkey").alias("method"), F.concat(F.lit("part:"), F.col("p_partkey") + F.col("p_size") % 3).alias("implementation"))


def expanded(r):
    return exp.expand_targets(r("call_site"), impls(r), r("symbol"), 1)


def exchanges(r):
    return ses.pair_requests(r("log_message"))


EXCHANGES = """SELECT q.sender, q.id, q.method, q.pos, q.ts_ms, a.pos AS answer_pos, a.ts_ms - q.ts_ms AS latency_ms, a.body AS answer FROM {log_message} q LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sender, id ORDER BY pos) AS n FROM {log_message} WHERE kind = 'response') WHERE n = 1) a
  ON a.id = q.id AND a.sender <> q.sender WHERE q.kind = 'request'"""
STEPPED = "SELECT m.*, coalesce(b.step, 'startup') AS step FROM {log_message} m LEFT JOIN (SELECT step, ts_ms AS from_ms, lead(ts_ms, 1, 9223372036854775807) OVER (ORDER BY ts_ms, step) AS end_ms FROM {mark}) b ON m.ts_ms >= b.from_ms AND m.ts_ms < b.end_ms"


def synced(r):
    """Sync messages by document; every third comes from the server and doesn't count."""
    short = F.when(F.col("event_type") == "signup", "didOpen").when(F.col("event_type") == "view", "didChange").when(F.col("event_type") == "error", "didClose").otherwise("hover")
    sender = F.when(F.col("event_id") % 3 == 0, "server").otherwise("client")
    return r("events").select(F.concat(F.lit("file:///u"), "user_id").alias("uri"), F.concat(F.lit("textDocument/"), short).alias("method"), sender.alias("sender"))


def stepped_messages(r):
    """Log messages with the document that they are about; those of method m3 open it."""
    opened = F.col("method").endswith("m3")
    return r("log_message").withColumn("uri", F.concat(F.lit("u"), F.col("pos") % 3)).withColumn("method", F.when(opened, "textDocument/didOpen").otherwise(F.col("method")))


STEP_MESSAGES = f"""SELECT step, pos, kind, concat('u', pos % 3) AS uri, method LIKE '%/m3' AS sync,
  CASE WHEN method LIKE '%/m3' THEN 'textDocument/didOpen' ELSE method END AS method FROM ({STEPPED}) WHERE sender = 'client'"""


OWN, OTHER = "rust-analyzer cargo shop 1 ", "rust-analyzer cargo parts 1 "


def code_index(r):
    return ing.analyze(*code_files(code_lines(r)))


def code_lines(r):
    """Lines of code with the last line of their order, which doesn't depend on their flags: all indexes over them share it."""
    return checkpointed(r("code_line").drop("seq").withColumn("last", F.max("no").over(Window.partitionBy("o_orderkey"))))


def code_files(c):
    """An index of one file per customer: orders are functions, their lines are calls, values and operators of parts.
    Occurrences are told by a line of the written `c` alone; texts are written once, as they are read many times."""
    name = F.when(F.col("flag") == "def", F.concat(F.lit("o"), "o_orderkey")).otherwise(F.concat(F.lit("p"), "partkey"))
    text = F.when(F.col("flag") == "def", F.concat(F.lit("fn "), name, F.lit("() {"))).when(F.col("flag") == "A", F.concat(F.lit("  "), name, F.lit("(x);"))).when(F.col("flag") == "N", F.concat(F.lit("  "), name, F.lit(";"))).otherwise("  ++;")
    width = F.when(F.col("flag") == "R", 2).otherwise(F.length(name))
    start = F.when(F.col("flag") == "def", 3).otherwise(2)
    defined = F.col("flag") == "def"
    occ = c.select(
        "path", F.lit(0).alias("doc_pos"), F.col("no").alias("pos"), F.concat(F.when(defined, OWN).otherwise(OTHER), name, F.lit("().")).alias("symbol"),
        F.array("no", start, start + width).alias("range"), F.when(defined, F.array("no", F.lit(0), "last", F.lit(99))).alias("enclosing_range"), defined.cast("int").alias("roles"),
    )
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", text.alias("text")))), lambda x: x["text"]), "\n")
    info = occ.where("roles = 1").select("path", "doc_pos", "pos", "symbol", F.lit("Function").alias("kind"))
    return occ, info, checkpointed(c.groupBy("path").agg(whole.alias("text")))


def code_generation(c, run_id, previous=None):
    occ, info, sources = code_files(c)
    files = sources.select("path", F.lit("rust").alias("language"), F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("content_hash"), F.octet_length("text").cast("long").alias("size"))
    run = c.sparkSession.range(1).select(F.lit(run_id).alias("run_id"), F.lit("rust").alias("provider"), F.lit("1").alias("provider_version"), F.expr("cast(array() as array<string>)").alias("args"), *[F.timestamp_seconds(F.lit(0)).alias(x) for x in ("started_at", "finished_at")], F.lit("succeeded").alias("status"))
    return ing.generation(occ, info, sources, files, run, "scip@rust-1", previous)


def incremental(r):
    """A generation published after one of an older tree, in which a tenth of the files had values for calls."""
    spark, root = r("region").sparkSession, round_trips.folder(r, "incremental")
    older = F.when((F.crc32("path") % 10 == 0) & (F.col("flag") == "A"), "N").otherwise(F.col("flag"))
    lines = code_lines(r)
    snapshots.publish_generation(spark, code_generation(lines.withColumn("flag", older), 1), root)
    snapshots.publish_generation(spark, code_generation(lines, 2, snapshots.read_generation(spark, root)), root)
    return snapshots.read_generation(spark, root)


def edges(r):
    r = lines_once(r)
    return gv.call_edges(r("call_site"), r("call_target"), r("symbol"))


EDGES = "SELECT s.site_id, a.module AS from_module, b.module AS to_module, s.caller, t.target, t.method FROM {call_site} s JOIN {call_target} t ON t.site_id = s.site_id JOIN {symbol} a ON a.id = s.caller JOIN {symbol} b ON b.id = t.target"
GRAPH = "SELECT from_module, to_module, count(DISTINCT site_id) AS calls FROM (" + EDGES + ") WHERE from_module <> to_module GROUP BY from_module, to_module"


def graph(r):
    return gv.module_edges(edges(r))


MERGED = """WITH RECURSIVE e AS (SELECT root, path, kind, row_number() OVER (PARTITION BY root, path ORDER BY ts, event_id) AS n FROM {change_event}),
  m AS (SELECT root, path, n, kind FROM e WHERE n = 1 UNION ALL SELECT e.root, e.path, e.n, CASE WHEN m.kind = 'none' THEN e.kind WHEN m.kind = 'created' AND e.kind = 'deleted' THEN 'none' WHEN m.kind = 'created' THEN 'created' WHEN m.kind = 'deleted' AND e.kind = 'created' THEN 'changed' ELSE e.kind END FROM m JOIN e ON e.root = m.root AND e.path = m.path AND e.n = m.n + 1)
  SELECT root, path, kind FROM m WHERE n = (SELECT max(n) FROM e WHERE e.root = m.root AND e.path = m.path) AND kind <> 'none'"""


def sites_at(r):
    return r("line").select("site_id", F.concat(F.lit("c"), "o_custkey").alias("file"), (F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")) * 10).cast("long").alias("at"))


SITES_AT = "SELECT site_id, concat('c', o_custkey) AS file, CAST(datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 10 AS BIGINT) AS at_ FROM {line}"


def nodes(r):
    return r("node").withColumn("parent_id", F.lit(None).cast("long")).withColumn("field", F.lit(None).cast("string"))


def callees(r):
    """The callee of each call node: its first 300 places."""
    return r("node").where("kind = 'call_expression'").select("node_id", "start", (F.col("start") + 300).alias("end_at"))


def arguments(r):
    """Each line of an order as an argument of its call: a quoted string, with an interpolation in it where the tax is
    low, or a number."""
    line = r("line")
    text = F.when(F.col("l_returnflag") == "A", F.concat(F.lit('"it\'s '), "l_partkey", F.lit('"'))).otherwise(F.concat(F.lit("'part "), "l_partkey", F.lit("'")))
    strings = line.select(F.col("site_id").alias("node_id"), F.col("l_orderkey").alias("parent_id"), F.when(F.col("l_linestatus") == "F", "string").otherwise("number").alias("kind"), F.col("site_id").alias("start"), text.alias("text"))
    mixed = line.where("l_tax < 0.03").select((-F.col("site_id")).alias("node_id"), F.col("site_id").alias("parent_id"), F.lit("interpolation").alias("kind"), F.col("site_id").alias("start"), F.lit("{x}").alias("text"))
    return strings.unionByName(mixed)


def tags3(r, extra):
    """A tag set per part; `extra` tells which parts a side has changed."""
    t = r("part").select(F.concat(F.lit("sym:p"), "p_partkey").alias("item"), F.explode(F.array(F.col("p_type"), F.when(F.expr(extra), F.lit("new-" + extra[:9])).otherwise(F.col("p_brand")))).alias("tag"))
    return t


def _tags3(extra):
    return f"SELECT concat('sym:p', p_partkey) AS item, unnest([p_type, CASE WHEN {extra} THEN 'new-{extra[:9]}' ELSE p_brand END]) AS tag FROM {{part}}"


SETS = lambda q: f"SELECT item, list_sort(list(DISTINCT tag)) AS x FROM ({q}) GROUP BY item"
MERGE = f"""SELECT item, CASE WHEN conflict THEN [] WHEN l <> b THEN l ELSE r END AS tags, conflict FROM (SELECT coalesce(b.item, l.item, r.item) AS item, coalesce(b.x, []) AS b, coalesce(l.x, []) AS l, coalesce(r.x, []) AS r, coalesce(l.x, []) <> coalesce(b.x, []) AND coalesce(r.x, []) <> coalesce(b.x, []) AND coalesce(l.x, []) <> coalesce(r.x, []) AS conflict
  FROM ({SETS(_tags3("FALSE"))}) b FULL JOIN ({SETS(_tags3("p_size % 4 = 0"))}) l ON l.item = b.item FULL JOIN ({SETS(_tags3("p_size % 6 = 0"))}) r ON r.item = b.item)"""

FLAG = fac.facet_eq("flag", "A") & ~fac.facet_eq("brand", "Brand#2") & (fac.facet_gt("size", 10) | fac.facet_path("type", "ECON.MY"))
FLAG_SQL = "SELECT item FROM (SELECT item, bool_or(key = 'flag' AND value = 'A') AS a, bool_or(key = 'brand' AND value = 'Brand#2') AS b, bool_or(key = 'size' AND TRY_CAST(value AS DOUBLE) > 10) AS c, bool_or(key = 'type' AND regexp_matches(value, '^ECON.MY$')) AS d FROM {tag} GROUP BY item) WHERE a AND NOT b AND (c OR d)"
GENS = "SELECT CAST(y AS BIGINT) AS n, y % 3 <> 0 AS complete FROM (SELECT DISTINCT year(l_shipdate) AS y FROM {lineitem})"


def gens(r):
    y = F.year("l_shipdate")
    return r("lineitem").select(y.cast("long").alias("n"), (y % 3 != 0).alias("complete")).distinct()


def occ_sites(r):
    """Name sites: positions of references, two columns off for some."""
    return r("line").select(F.col("site_id").alias("ref_id"), F.concat(F.lit("c"), "o_custkey").alias("path"), F.col("l_linenumber").cast("int").alias("line"), (F.col("l_quantity") + F.when(F.col("l_tax") > 0.06, 2).otherwise(0)).cast("int").alias("character"))


OCC_SITES = "SELECT site_id AS ref_id, concat('c', o_custkey) AS path, CAST(l_linenumber AS INT) AS line, CAST(l_quantity + CASE WHEN l_tax > 0.06 THEN 2 ELSE 0 END AS INT) AS character FROM {line}"

ENTRIES = {
    # Resolution
    "resolved_flag": (lambda r: res.resolved_flag(r("call_site"), r("call_target")).select("site_id", "resolved"), f"SELECT site_id, {RESOLVED} AS resolved FROM {{call_site}} s"),
    "site_dimensions": (lambda r: res.site_dimensions(r("call_site"), r("file"), r("symbol")).select("site_id", "language", "package", "module"), "SELECT s.site_id, f.language, y.package, y.module FROM {call_site} s LEFT JOIN {file} f ON f.path = s.file LEFT JOIN {symbol} y ON y.id = s.caller"),
    "resolution_by_module": (by_module, BY_MODULE),
    "resolution_rollup": (lambda r: res.resolution_rollup(by_module(r)), f"SELECT CASE WHEN g = 0 THEN 'language' ELSE 'total' END AS level, language, call_sites, resolved, unresolved, unresolved / call_sites AS rate FROM (SELECT grouping(language) AS g, language, CAST(sum(call_sites) AS BIGINT) AS call_sites, CAST(sum(resolved) AS BIGINT) AS resolved, CAST(sum(unresolved) AS BIGINT) AS unresolved FROM ({BY_MODULE}) GROUP BY ROLLUP (language))"),
    "unresolved_rate": (lambda r: by_module(r).select("language", "package", "module", res.unresolved_rate(F.col("call_sites"), F.col("unresolved")).alias("rate")), f"SELECT language, package, module, unresolved / call_sites AS rate FROM ({BY_MODULE})"),
    "order_report": (lambda r: res.order_report(by_module(r)), f"SELECT * FROM ({BY_MODULE}) ORDER BY language NULLS LAST, package NULLS LAST, module NULLS FIRST"),
    "edge_counts": (lambda r: res.edge_counts(r("run"), r("run_file")), "SELECT provider, path, CAST(sum(edge_count) AS BIGINT) AS edge_count FROM {run_file} JOIN {run} USING (run_id) GROUP BY provider, path"),
    "run_file_counts": (lambda r: res.run_file_counts(r("file"), r("call_site")), "SELECT f.path, count(s.site_id) AS edge_count FROM {file} f LEFT JOIN {call_site} s ON s.file = f.path GROUP BY f.path"),
    "run_edges_per_file": (lambda r: res.run_edges_per_file(r("file").select(F.lit(1).alias("run_id"), "path"), 1, r("call_site"), r("call_target").where("method = 'declared'"), 1), "SELECT path, (SELECT count(*) FROM {call_target} t JOIN {call_site} s ON s.site_id = t.site_id WHERE s.file = f.path AND s.run_id = 1 AND t.method = 'declared') AS edge_count FROM {file} f"),
    "inherit_source_tree": (lambda r: res.inherit_source_tree(r("run").select("run_id", "provider", F.concat(F.lit("tree"), "run_id").alias("source_tree")), 1998, 1996), "SELECT run_id, provider, CASE WHEN run_id = 1998 THEN 'tree1996' ELSE concat('tree', run_id) END AS source_tree FROM {run}"),
    "unresolved_by_module": (lambda r: res.unresolved_by_module(r("call_site"), r("call_target"), r("symbol")), f"SELECT m.module, count(s.site_id) FILTER (WHERE NOT resolved) AS unresolved, count(s.site_id) AS call_sites FROM (SELECT DISTINCT module FROM {{symbol}} WHERE module IS NOT NULL) m LEFT JOIN (SELECT y.module, s.site_id, {RESOLVED} AS resolved FROM {{call_site}} s JOIN {{symbol}} y ON y.id = s.caller) s ON s.module = m.module GROUP BY m.module"),
    # Drops and differences
    "is_drop": (lambda r: r("edges_by_year").select("generation", "path", reg.is_drop(F.col("edge_count") - 40, F.col("edge_count") % 30).alias("dropped")), "SELECT generation, path, CASE WHEN edge_count - 40 <= 0 THEN FALSE WHEN edge_count % 30 <= 0 THEN TRUE ELSE (edge_count - 40 - edge_count % 30) * 100 > (edge_count - 40) * 50 END AS dropped FROM {edges_by_year}"),
    "edge_regressions": (drops, DROPS),
    "edge_diff": (diffs, DIFFS),
    "previous_generation": (lambda r: reg.previous_generation(gens(r)), f"SELECT n, complete, max(CASE WHEN complete THEN n END) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM ({GENS})"),
    "retention": (lambda r: reg.retention(gens(r)), f"SELECT n, complete, complete AND row_number() OVER (PARTITION BY complete ORDER BY n DESC) <= 2 AS kept FROM ({GENS})"),
    "newest": (lambda r: gens(r).where("complete").agg(F.max("n").alias("newest")), f"SELECT max(n) AS newest FROM ({GENS}) WHERE complete"),
    "report_passed": (lambda r: reg.report_passed(drops(r), diffs(r)), f"SELECT (SELECT count(*) FROM ({DROPS})) + (SELECT count(*) FROM ({DIFFS})) = 0 AS passed"),
    "drop_lines": (lambda r: reg.drop_lines(drops(r)), f"SELECT provider, path, concat('drop ', provider, ' ', path, ': ', previous, ' -> ', coalesce(CAST(current AS VARCHAR), 'none')) AS line FROM ({DROPS})"),
    "diff_lines": (lambda r: reg.diff_lines(diffs(r)), f"SELECT provider, path, concat('- ', provider, ' ', path, ' ', expected) AS line FROM ({DIFFS}) WHERE expected IS NOT NULL UNION ALL SELECT provider, path, concat('+ ', provider, ' ', path, ' ', found) FROM ({DIFFS}) WHERE found IS NOT NULL"),
    # Attribution
    "attribute_innermost": (innermost, INNERMOST),
    "attribute_innermost_location": (lambda r: att.attribute_innermost_location(r("reference"), r("definition")), INNERMOST.replace("caller", "function")),
    "locate_definition": (lambda r: att.locate_definition(r("reference"), r("definition")), """SELECT ref_id, symbol FROM (SELECT r.ref_id, d.symbol, row_number() OVER (PARTITION BY r.ref_id ORDER BY start_line DESC, start_character DESC, d.pos DESC) AS n FROM {reference} r JOIN {definition} d ON r.path = d.path
      AND (d.start_line < r.line OR d.start_line = r.line AND d.start_character <= r.character) AND (r.line < d.end_line OR r.line = d.end_line AND r.character < d.end_character)) WHERE n = 1"""),
    "outside_definition": (lambda r: att.outside_definition(r("reference"), innermost(r)).select("ref_id"), f"SELECT ref_id FROM {{reference}} WHERE ref_id NOT IN (SELECT ref_id FROM ({INNERMOST}))"),
    "documents_without_attribution": (lambda r: att.documents_without_attribution(r("reference"), innermost(r)), f"SELECT DISTINCT path FROM {{reference}} WHERE path NOT IN (SELECT path FROM {{reference}} JOIN ({INNERMOST}) USING (ref_id))"),
    "skip_reason": (lambda r: reasons(r).select("pos", "reason"), f"SELECT pos, reason FROM ({REASON})"),
    "skip_counts": (lambda r: att.skip_counts(reasons(r)), f"SELECT reason, count(*) AS n FROM ({REASON}) WHERE reason IS NOT NULL AND reason <> 'definition' GROUP BY reason"),
    "drop_locals": (lambda r: att.drop_locals(r("occurrence")).select("pos", "symbol"), "SELECT pos, symbol FROM {occurrence} WHERE symbol NOT LIKE 'local %'"),
    "is_definition": (lambda r: r("occurrence").select("pos", att.is_definition(F.col("roles")).alias("is_definition")), "SELECT pos, roles & 1 <> 0 AS is_definition FROM {occurrence}"),
    "decode_range": (lambda r: r("occurrence").select("pos", att.decode_range(F.lit(None), F.when(F.col("line") % 2 == 0, F.array("line", "character", F.col("character") + 4)).otherwise(F.array("line", "character", F.col("line") + 1, F.col("character")))).alias("x")).select("pos", "x.*"), "SELECT pos, line AS start_line, character AS start_character, CASE WHEN line % 2 = 0 THEN line ELSE line + 1 END AS end_line, CASE WHEN line % 2 = 0 THEN character + 4 ELSE character END AS end_character FROM {occurrence}"),
    "first_definition": (lambda r: att.first_definition(r("occurrence")), "SELECT symbol, path, line, character FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pos) AS n FROM {occurrence} WHERE symbol NOT LIKE 'local %' AND roles & 1 <> 0) WHERE n = 1"),
    "number_sites": (lambda r: att.number_sites(r("call_site")).select("site_id", "ordinal"), "SELECT site_id, CAST(row_number() OVER (PARTITION BY caller ORDER BY file, line, col, declared_target, site_id) AS INT) AS ordinal FROM {call_site}"),
    "assign_ids": (lambda r: att.assign_ids(r("call_site"), 1000, "file", ["line", "col", "declared_target", "site_id"]).select("site_id", F.col("new_id").cast("long").alias("new_id")), "SELECT site_id, 1000 + row_number() OVER (ORDER BY file, line, col, declared_target, site_id) AS new_id FROM {call_site}"),
    "edges_without_occurrence": (lambda r: att.edges_without_occurrence(occ_sites(r), r("occurrence")).select("ref_id"), f"SELECT ref_id FROM ({OCC_SITES}) e WHERE NOT EXISTS (SELECT 1 FROM {{occurrence}} o WHERE o.path = e.path AND o.line = e.line AND o.character = e.character)"),
    "unresolved_sites": (lambda r: att.unresolved_sites(occ_sites(r), r("occurrence")).select("ref_id", "reason"), f"""SELECT ref_id, CASE WHEN named IS NULL THEN 'no-occurrence' WHEN NOT named THEN 'unnamed-local' END AS reason FROM ({OCC_SITES}) e LEFT JOIN (SELECT o.path, o.line, o.character, bool_or(o.symbol NOT LIKE 'local %' OR d.symbol IS NOT NULL) AS named FROM {{occurrence}} o
      LEFT JOIN (SELECT DISTINCT path, symbol FROM {{occurrence}} WHERE symbol LIKE 'local %' AND roles & 1 <> 0) d ON d.path = o.path AND d.symbol = o.symbol GROUP BY o.path, o.line, o.character) o ON o.path = e.path AND o.line = e.line AND o.character = e.character"""),
    # Symbols and names
    "canonical_name": (lambda r: named(r).select("symbol", "n", "name"), CANON),
    "parse_symbols": (lambda r: parsed(r).select("n", "parsed.scheme", F.size("parsed.descriptors").alias("parts"), F.col("parsed.error").isNull().alias("ok")), f"SELECT n, CASE WHEN is_local THEN NULL WHEN rust THEN 'rust-analyzer' ELSE 'scip-go' END AS scheme, CAST(CASE WHEN is_local THEN 0 WHEN rust AND body LIKE '%#run' THEN 3 ELSE 2 END AS INT) AS parts, TRUE AS ok FROM ({PARSED})"),
    "format_symbol": (lambda r: parsed(r).select("n", sym.format_symbol(F.col("parsed")).alias("symbol")), "SELECT n, symbol FROM {symbol_string}"),
    "module_ancestors": (lambda r: parsed(r).select("n", F.array_join(sym.module_ancestors(F.col("parsed")), ",").alias("modules")), rf"SELECT n, CASE WHEN is_local THEN '' ELSE concat(CASE WHEN rust THEN 'my_shop.' ELSE '' END, replace(regexp_extract(body, CASE WHEN rust THEN '^[^/]*' ELSE '^a/[^/]*' END), '/', '.')) END AS modules FROM ({PARSED})"),
    "symbol_kind": (lambda r: parsed(r).select("n", sym.symbol_kind(F.col("parsed"), F.when(F.col("n") % 4 == 0, "TraitMethod")).alias("kind")), f"SELECT n, CASE WHEN n % 4 = 0 THEN 'trait_method' WHEN is_local THEN 'unknown' WHEN tail = '#' THEN 'type' WHEN tail = '.' THEN 'term' WHEN body LIKE '%#run' THEN 'method' ELSE 'function' END AS kind FROM ({PARSED})"),
    "symbol_predicates": (lambda r: parsed(r).select("n", *[f(F.col("parsed"), F.lit(None).cast("string")).alias(c) for c, f in (("callable", sym.is_callable), ("module", sym.is_module), ("macro", sym.is_macro))]), f"SELECT n, tail = '().' AS callable, FALSE AS module, FALSE AS macro FROM ({PARSED})"),
    "dispatch_class": (lambda r: parsed(r).select("n", sym.dispatch_class(F.col("parsed")).alias("dispatch")), f"SELECT n, CASE WHEN rust AND tail = '().' THEN 'virtual' ELSE 'unknown' END AS dispatch FROM ({PARSED})"),
    "ref_kind": (lambda r: r("occurrence").select("pos", sym.ref_kind(F.col("line") == 1, F.col("character") > 20).alias("ref_kind")), "SELECT pos, CASE WHEN line = 1 THEN 'macro' WHEN character > 20 THEN 'call' ELSE 'value' END AS ref_kind FROM {occurrence}"),
    "namespace_class": (lambda r: named(r).select("symbol", "class").distinct(), f"SELECT symbol, class FROM ({CLASSED})"),
    "assign_names": (lambda r: assigned(r), ASSIGNED),
    "name_collisions": (lambda r: nam.name_collisions(r("symbol").select(F.col("id").alias("symbol"), "name")), "SELECT name, list_sort(list(DISTINCT id)) AS symbols FROM {symbol} GROUP BY name HAVING count(DISTINCT id) > 1"),
    "unique_names": (lambda r: nam.unique_names(r("symbol").select(F.col("id").alias("symbol"), "name")), "SELECT name, min(id) AS symbol FROM {symbol} GROUP BY name HAVING count(DISTINCT id) = 1"),
    "union_symbols": (lambda r: nam.union_symbols(r("symbol").select(F.col("id").alias("symbol")), r("call_target").select(F.col("target").alias("symbol"))), "SELECT id AS symbol FROM {symbol} UNION SELECT target FROM {call_target}"),
    "merge_definitions": (lambda r: nam.merge_definitions(r("occurrence").select("symbol", "pos", "path", F.when(F.col("character") > 10, F.col("kind")).alias("kind")), r("occurrence").where("roles = 1").select("symbol", "pos", "path", F.col("line").alias("start_line"), (F.col("line") + 2).alias("end_line"))), """SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(b.path, a.info_file) AS file, a.kind, b.line + 1 AS start_line, b.line + 3 AS end_line FROM (SELECT symbol, arg_min(path, pos) AS info_file, arg_min(CASE WHEN character > 10 THEN kind END, CASE WHEN character > 10 THEN pos END) AS kind FROM {occurrence} GROUP BY symbol) a
      FULL JOIN (SELECT symbol, arg_min(path, pos) AS path, arg_min(line, pos) AS line FROM {occurrence} WHERE roles = 1 GROUP BY symbol) b ON a.symbol = b.symbol"""),
    "is_external": (lambda r: nam.is_external(r("part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_type").alias("manager"), F.col("p_brand").alias("package")), r("part").where("p_size < 4").select(F.col("p_type").alias("manager"), F.col("p_brand").alias("package"))).select("id", "external"), "SELECT concat('part:', p_partkey) AS id, NOT EXISTS (SELECT 1 FROM {part} q WHERE q.p_size < 4 AND q.p_type = p.p_type AND q.p_brand = p.p_brand) AS external FROM {part} p"),
    # Text
    "normalize_path": (lambda r: r("url").select("page_id", txt.normalize_path(F.replace("url", F.lit("/"), F.lit("\\"))).alias("path")), "SELECT page_id, url AS path FROM {url}"),
    "windows_names": (lambda r: r("url").select("page_id", txt.to_windows_name(F.col("url")).alias("name"), (txt.from_windows_name(txt.to_windows_name(F.col("url"))) == F.col("url")).alias("round_trip")), "SELECT page_id, translate(url, '<>:\"|?*', concat(chr(61500), chr(61502), chr(61498), chr(61474), chr(61564), chr(61503), chr(61482))) AS name, TRUE AS round_trip FROM {url}"),
    "item_ids": (lambda r: r("part").select("p_partkey", txt.encode_item_id(F.lit("sym"), F.col("p_name")).alias("item")).withColumn("x", txt.decode_item_id(F.col("item"))).select("p_partkey", "item", "x.space", "x.name", "x.error"), "SELECT p_partkey, CASE WHEN regexp_matches(p_name, '[\\s\"]') THEN concat('sym:\"', p_name, '\"') ELSE concat('sym:', p_name) END AS item, 'sym' AS space, p_name AS name, NULL::VARCHAR AS error FROM {part}"),
    "relative_uri": (lambda r: r("url").select("page_id", txt.relative_uri(F.replace("url", F.lit("https://"), F.lit("file:///srv/")), F.lit("/srv")).alias("path")), "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN url_decode(substr(url, 9)) END AS path FROM {url}"),
    "unquote_literal": (lambda r: r("part").select("p_partkey", txt.unquote_literal(F.concat(F.lit('r#"'), "p_name", F.lit('"#'))).alias("text")), "SELECT p_partkey, p_name AS text FROM {part}"),
    "source_tag": (lambda r: r("part").select("p_partkey", txt.source_tag(F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, F.col("p_type")).otherwise(F.concat_ws(" ", "p_type", F.col("p_size").cast("string")))).alias("tag")), "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'scip@unknown' WHEN p_size % 3 = 1 THEN concat('scip@', p_type) ELSE concat('scip@', p_type, '-', p_size) END AS tag FROM {part}"),
    "declares_function": (lambda r: r("source_line").select("doc_id", txt.declares_function(F.lit("python"), F.concat(F.when(F.col("doc_id") % 3 == 0, "def ").otherwise("undef "), "text")).alias("declares")), "SELECT doc_id, regexp_matches(concat(CASE WHEN doc_id % 3 = 0 THEN 'def ' ELSE 'undef ' END, text), '(^|[^\\p{L}\\p{N}_])def\\s+[\\p{L}_]') AS declares FROM {source_line}"),
    "is_name": (lambda r: r("source_line").select("doc_id", txt.is_name(F.col("text"), F.lit(40), F.lit(42)).alias("named")), "SELECT doc_id, CASE WHEN length(text) >= 42 THEN regexp_matches(substr(text, 41, 2), '[\\p{L}\\p{N}_]') END AS named FROM {source_line}"),
    "is_called": (lambda r: r("part").select("p_partkey", txt.is_called(F.when(F.col("p_size") % 4 == 0, " (x)").when(F.col("p_size") % 4 == 1, "::<A<B>, C> (x)").when(F.col("p_size") % 4 == 2, "::<A>").otherwise(".x()")).alias("called")), "SELECT p_partkey, p_size % 4 IN (0, 1) AS called FROM {part}"),
    "json_path": (lambda r: r("events").select("event_id", txt.json_path(F.col("props"), "k").alias("k")), "SELECT event_id, json_extract_string(props, '$.k') AS k FROM {events}"),
    "describe_response": (lambda r: r("events").select("event_id", txt.describe_response(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"error":{"code":-32601,"message":"'), "event_type", F.lit('"}}'))).otherwise(F.concat(F.lit('{"result":'), "props", F.lit("}")))).alias("said")), "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('error -32601 ', event_type) ELSE concat('result ', json(props)) END AS said FROM {events}"),
    "log_failures": (lambda r: txt.log_failures(r("events").select(F.when(F.col("event_type") == "error", F.concat(F.lit("Error: "), "event_id")).when(F.col("event_type") == "view", F.concat(F.lit("Analysis errors: "), F.col("event_id") % 2)).when(F.col("event_type") == "click", F.concat(F.lit("info: skipping file 'f"), "event_id", F.lit("' because it is large"))).otherwise("fine").alias("line"))), "SELECT * FROM (SELECT CASE event_type WHEN 'error' THEN concat('Error: ', event_id) WHEN 'view' THEN concat('Analysis errors: ', event_id % 2) WHEN 'click' THEN concat('info: skipping file ''f', event_id, ''' because it is large') END AS line, CASE event_type WHEN 'click' THEN concat('f', event_id) END AS skipped_file FROM {events} WHERE event_type IN ('error', 'click') OR event_type = 'view' AND event_id % 2 = 1)"),
    # Expansion
    "called_trait_methods": (lambda r: exp.called_trait_methods(r("call_site"), r("symbol"), 1), "SELECT DISTINCT s.declared_target AS symbol FROM {call_site} s JOIN {symbol} y ON y.id = s.declared_target AND y.kind = 'trait_method' AND y.file IS NOT NULL WHERE s.run_id = 1"),
    "expand_targets": (expanded, EXPANDED),
    "unmapped_answers": (lambda r: exp.unmapped_answers(r("reference").select("ref_id"), att.locate_definition(r("reference"), r("definition")).withColumn("symbol", F.replace("symbol", F.lit("sym:"), F.lit("order:"))), r("symbol").where("module IS NOT NULL")), """SELECT r.ref_id FROM {reference} r WHERE r.ref_id NOT IN (SELECT ref_id FROM (SELECT r.ref_id, d.symbol, row_number() OVER (PARTITION BY r.ref_id ORDER BY start_line DESC, start_character DESC, d.pos DESC) AS n FROM {reference} r JOIN {definition} d ON r.path = d.path
      AND (d.start_line < r.line OR d.start_line = r.line AND d.start_character <= r.character) AND (r.line < d.end_line OR r.line = d.end_line AND r.character < d.end_character)) JOIN {symbol} y ON y.id = replace(symbol, 'sym:', 'order:') AND y.module IS NOT NULL WHERE n = 1)"""),
    "expansion_summary": (lambda r: exp.expansion_summary(expanded(r), exp.called_trait_methods(r("call_site"), r("symbol"), 1)), f"SELECT (SELECT count(DISTINCT s.declared_target) FROM {{call_site}} s JOIN {{symbol}} y ON y.id = s.declared_target AND y.kind = 'trait_method') AS methods, count(DISTINCT target) AS implementations, count(*) AS target_rows, count(DISTINCT site_id) AS sites FROM ({EXPANDED})"),
    "candidate_count": (lambda r: exp.candidate_count(r("call_target")), "SELECT site_id, target, method, count(*) OVER (PARTITION BY site_id, method) AS candidates FROM {call_target}"),
    "list_call_sites": (lambda r: exp.list_call_sites(*map(lines_upto(r, "l_quantity"), ("call_site", "symbol"))), "SELECT s.site_id, s.file, s.line, s.col, a.name AS caller_name, b.name AS target_name FROM {call_site} s JOIN {symbol} a ON a.id = s.caller JOIN {symbol} b ON b.id = s.declared_target"),
    "list_call_targets": (lambda r: exp.list_call_targets(*map(lines_once(r), ("call_site", "call_target", "symbol"))), "SELECT t.site_id, s.file, s.line, a.name AS caller_name, b.name AS target_name, t.method, t.candidates FROM (SELECT *, count(*) OVER (PARTITION BY site_id, method) AS candidates FROM {call_target}) t JOIN {call_site} s ON s.site_id = t.site_id JOIN {symbol} a ON a.id = s.caller JOIN {symbol} b ON b.id = t.target"),
    "implementers": (lambda r: exp.implementers(r("part").select(F.concat(F.lit("part:"), "p_partkey").alias("symbol"), F.array(F.struct(F.col("p_type").alias("symbol"), (F.col("p_size") > 25).alias("is_implementation")), F.struct(F.col("p_brand").alias("symbol"), F.lit(False).alias("is_implementation"))).alias("relationships"))), "SELECT concat('part:', p_partkey) AS symbol, p_type AS implemented FROM {part} WHERE p_size > 25"),
    "calls_reach": (lambda r: exp.calls_reach(r("call_site").select("file", "line", F.col("declared_target").alias("callee"), F.when(F.col("ref_kind") == "call", "function").otherwise("module").alias("callee_kind"))), "SELECT file, line, list_sort(list(DISTINCT declared_target)) AS callees FROM {call_site} WHERE ref_kind = 'call' GROUP BY file, line"),
    "ingest_sites": (
        lambda r: code_index(r)["sites"],
        f"""SELECT concat('{OWN}o', o_orderkey, '().') AS caller, path AS file, no + 1 AS line, 3 AS col, CASE WHEN flag = 'A' THEN 'call' ELSE 'value' END AS ref_kind, concat('{OTHER}p', partkey, '().') AS declared_target,
              'static' AS dispatch, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY no) AS INT) AS ordinal FROM {{code_line}} WHERE flag IN ('A', 'N')""",
    ),
    "incremental_sites": (
        lambda r: incremental(r)["call_site"].select("run_id", "caller", "file", "line", "col", "ordinal", "ref_kind", "declared_target", "dispatch", "source"),
        f"""SELECT CAST(2 AS INT) AS run_id, concat('{OWN}o', o_orderkey, '().') AS caller, path AS file, no + 1 AS line, 3 AS col, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY no) AS INT) AS ordinal, CASE WHEN flag = 'A' THEN 'call' ELSE 'value' END AS ref_kind,
              concat('{OTHER}p', partkey, '().') AS declared_target, 'static' AS dispatch, 'scip@rust-1' AS source FROM {{code_line}} WHERE flag IN ('A', 'N')""",
    ),
    "generation_run_files": (
        lambda r: code_generation(code_lines(r), 7)["run_file"],
        "SELECT CAST(7 AS INT) AS run_id, path, count(*) FILTER (WHERE flag IN ('A', 'N')) AS edge_count FROM {code_line} GROUP BY path",
    ),
    "ingest_skipped": (lambda r: code_index(r)["skipped"], "SELECT 'operator' AS reason, count(*) AS n FROM {code_line} WHERE flag = 'R' HAVING count(*) > 0"),
    "symbol_table": (
        lambda r: code_index(r)["symbols"],
        f"""SELECT concat('{OWN}o', o_orderkey, '().') AS symbol, concat('shop.o', o_orderkey) AS name, 'function' AS kind, min(path) AS file, CAST(min(no) + 1 AS INT) AS start_line, CAST(max(no) + 1 AS INT) AS end_line,
              CAST([] AS VARCHAR[]) AS modules, 'shop' AS package, FALSE AS external FROM {{code_line}} GROUP BY o_orderkey
            UNION ALL SELECT DISTINCT concat('{OTHER}p', partkey, '().'), concat('parts.p', partkey), 'function', NULL, NULL, NULL, CAST([] AS VARCHAR[]), 'parts', TRUE FROM {{code_line}} WHERE flag IN ('A', 'N')""",
    ),
    "has_edge": (
        lambda r: exp.has_edge(r("call_site").select("file", "line", F.col("declared_target").alias("callee")), r("call_site").select("site_id", "file", "line", F.concat(F.lit("part:"), F.expr("site_id % 50")).alias("callee"))).select("site_id", "found"),
        "SELECT site_id, (file, line, concat('part:', site_id % 50)) IN (SELECT (file, line, declared_target) FROM {call_site}) AS found FROM {call_site}",
    ),
    "module_loads": (lambda r: exp.module_loads(r("call_site").select("file", "line", F.col("declared_target").alias("callee"), F.when(F.col("ref_kind") == "call", "function").otherwise("module").alias("callee_kind"))), "SELECT DISTINCT file, line, declared_target AS callee FROM {call_site} WHERE ref_kind <> 'call'"),
    "ingest_summary": (lambda r: exp.ingest_summary(r("file"), r("symbol"), r("call_site"), reasons(r).where("reason IS NOT NULL AND reason <> 'definition'"), nam.collided_names(r("symbol").select(F.col("id").alias("symbol"), "name"))), f"SELECT (SELECT count(*) FROM {{file}}) AS files, (SELECT count(*) FROM {{symbol}}) AS symbols, (SELECT count(*) FROM {{call_site}}) AS call_sites, (SELECT count(*) FROM ({REASON}) WHERE reason IS NOT NULL AND reason <> 'definition') AS skipped, (SELECT count(*) FROM (SELECT name FROM {{symbol}} GROUP BY name HAVING count(DISTINCT id) > 1)) AS collisions"),
    # Checks
    "check_edges": (lambda r: chk.check_edges(r("call_target").where("method = 'vta'"), r("occurrence").select("path", (F.col("kind") == "method").alias("callable"))), "SELECT concat('no call edges, though functions are referenced in ', min(path)) AS error FROM {occurrence} WHERE kind = 'method' AND NOT EXISTS (SELECT 1 FROM {call_target} WHERE method = 'vta')"),
    "check_index": (lambda r: chk.check_index(r("file"), r("occurrence").where("line > 99"), r("file").select("path", (F.col("size") > 100).alias("declares"))), "SELECT concat('no occurrences, though a function is declared in ', min(path)) AS error FROM {file} WHERE size > 100"),
    "check_resolved": (lambda r: chk.check_resolved(att.unresolved_sites(occ_sites(r), r("occurrence")).where("reason IS NOT NULL").withColumn("called", F.lit(True))), f"SELECT concat('all ', n, ' called names are unresolved') AS error FROM (SELECT count(*) AS n FROM ({OCC_SITES}) e LEFT JOIN (SELECT o.path, o.line, o.character, bool_or(o.symbol NOT LIKE 'local %' OR d.symbol IS NOT NULL) AS named FROM {{occurrence}} o LEFT JOIN (SELECT DISTINCT path, symbol FROM {{occurrence}} WHERE symbol LIKE 'local %' AND roles & 1 <> 0) d ON d.path = o.path AND d.symbol = o.symbol GROUP BY o.path, o.line, o.character) o ON o.path = e.path AND o.line = e.line AND o.character = e.character WHERE named IS NULL OR NOT named)"),
    "check_call_graph": (lambda r: chk.check_call_graph(r("file"), r("symbol"), r("call_site"), r("call_target").where("method = 'jelly'")), "SELECT 'no function edges' AS error FROM {region} WHERE r_regionkey = 0"),
    "check_constraints": (
        lambda r: chk.check_constraints(
            {
                "run": r("run").withColumn("status", F.when(F.col("run_id") == 1999, "ok").otherwise(F.col("status"))),
                "file": r("file").union(r("file").where("size = 50")),
                "call_site": r("call_site").withColumn("dispatch", F.when(F.col("col") == 7, "odd").otherwise(F.col("dispatch"))),
                "call_target": r("call_target").select(
                    F.when(F.col("site_id") % 997 == 0, -F.col("site_id")).otherwise(F.col("site_id")).alias("site_id"),
                    F.when(F.col("site_id") % 991 != 0, F.col("target")).alias("target"),
                    F.when(F.col("site_id") % 983 == 0, "scip").otherwise(F.col("method")).alias("method"),
                ),
            }
        ),
        """SELECT 'file' AS "table", 'primary key' AS "constraint", path AS key FROM {file} WHERE size = 50
          UNION ALL SELECT DISTINCT 'call_target', 'references call_site', CAST(-site_id AS VARCHAR) FROM {call_target} WHERE site_id % 997 = 0 AND site_id <> 0
          UNION ALL SELECT 'call_target', 'not null target', CAST(count(*) AS VARCHAR) FROM {call_target} WHERE site_id % 991 = 0 HAVING count(*) > 0
          UNION ALL SELECT DISTINCT 'call_target', 'check method', 'scip' FROM {call_target} WHERE site_id % 983 = 0
          UNION ALL SELECT DISTINCT 'call_site', 'check dispatch', 'odd' FROM {call_site} WHERE col = 7
          UNION ALL SELECT 'run', 'check status', 'ok' FROM {run} WHERE run_id = 1999
          UNION ALL SELECT DISTINCT 'call_site', 'references run', CAST(run_id AS VARCHAR) FROM {call_site}""",
    ),
    "check_declared_targets": (lambda r: chk.check_declared_targets(r("call_site"), r("call_target"), "declared"), "SELECT s.site_id FROM {call_site} s LEFT JOIN {call_target} t ON t.site_id = s.site_id GROUP BY s.site_id HAVING count(t.target) <> 1 OR NOT bool_and(t.target = s.declared_target AND t.method = 'declared')"),
    "local_leaks": (lambda r: chk.local_leaks(r("call_site").select("caller", F.when(F.col("col") == 9, F.concat(F.lit("local "), "line")).otherwise(F.col("declared_target")).alias("declared_target")), r("call_target"), r("symbol")), "SELECT concat('local ', line) AS symbol FROM {call_site} WHERE col = 9"),
    # Generations
    "source_tree_hash": (lambda r: gen.source_tree_hash(r("file"), "language"), "SELECT language, sha256(string_agg(concat(path, ' ', content_hash), chr(10) ORDER BY path)) AS source_tree FROM {file} GROUP BY language"),
    "insert_if_absent": (lambda r: gen.insert_if_absent(r("symbol").where("id LIKE '%1'").select("name", "id"), r("symbol").select("name", "id"), ["name"], ["id"]), "SELECT name, id FROM {symbol} WHERE id LIKE '%1' UNION ALL SELECT name, min(id) FROM {symbol} WHERE name NOT IN (SELECT name FROM {symbol} WHERE id LIKE '%1') GROUP BY name"),
    "generation_without": (lambda r: gen.generation_without({t: r(t) for t in ("file", "symbol", "call_site", "call_target")}, "src/c5.rs")["call_target"], "SELECT t.site_id, t.target, t.method FROM {call_target} t JOIN {call_site} s ON s.site_id = t.site_id WHERE s.file <> 'src/c5.rs'"),
    "carry_forward": (lambda r: gen.carry_forward(r("call_site"), r("file"), r("file").withColumn("content_hash", F.when(F.col("size") > 120, "new").otherwise(F.col("content_hash")))).select("site_id"), "SELECT site_id FROM {call_site} JOIN {file} ON file = path WHERE size <= 120"),
    "distinct_sources": (lambda r: gen.distinct_sources(r("call_target").select(F.col("method").alias("source"))), "SELECT DISTINCT method AS source FROM {call_target}"),
    # Changes
    "merge_events": (lambda r: chg.merge_events(r("change_event")), MERGED),
    "snapshot_diff": (lambda r: chg.snapshot_diff(r("snapshot_old"), r("snapshot_new")), "SELECT path, kind FROM (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'created' WHEN b.path IS NULL THEN 'deleted' WHEN a.is_dir <> b.is_dir OR NOT b.is_dir AND (a.len <> b.len OR a.modified <> b.modified) THEN 'changed' END AS kind FROM {snapshot_old} a FULL JOIN {snapshot_new} b ON a.path = b.path) WHERE kind IS NOT NULL"),
    "subtree": (lambda r: chg.subtree(r("snapshot_old"), r("nation").where("n_nationkey % 4 = 0").select(F.concat(F.lit("d"), "n_nationkey").alias("dir"))), "SELECT dir, path FROM {snapshot_old} JOIN (SELECT concat('d', n_nationkey) AS dir FROM {nation} WHERE n_nationkey % 4 = 0) ON path = dir OR starts_with(path, concat(dir, '/'))"),
    "cascade_delete": (lambda r: chg.cascade_delete(r("nation").where("n_nationkey = 3").select(F.concat(F.lit("d"), "n_nationkey").alias("dir")), r("snapshot_old")), "SELECT path, 'deleted' AS kind FROM {snapshot_old} WHERE starts_with(path, 'd3/')"),
    "classify_path": (lambda r: r("url").select("page_id", chg.classify_path(F.regexp_replace("url", "^[a-z]+://", ""), ["ththre.example.com"], ["en"]).alias("class")), "SELECT page_id, CASE WHEN p = 'ththre.example.com' OR starts_with(p, 'ththre.example.com/') OR list_contains(string_split(p, '/'), 'en') THEN 'excluded' ELSE 'watched' END AS class FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p FROM {url})"),
    "classify_change": (lambda r: chg.classify_change(r("snapshot_new"), r("snapshot_old").where("not is_dir")), "SELECT b.path, CASE WHEN a.path IS NULL THEN 'created' WHEN a.is_dir <> b.is_dir THEN 'deleted' ELSE 'changed' END AS kind FROM {snapshot_new} b LEFT JOIN (SELECT * FROM {snapshot_old} WHERE NOT is_dir) a ON a.path = b.path WHERE a.path IS NULL OR a.is_dir <> b.is_dir OR NOT b.is_dir AND (a.len <> b.len OR a.modified <> b.modified) UNION ALL SELECT b.path, 'created' FROM {snapshot_new} b JOIN {snapshot_old} a ON a.path = b.path WHERE NOT a.is_dir AND b.is_dir"),
    "advance_baseline": (lambda r: chg.advance_baseline(r("snapshot_old"), chg.snapshot_diff(r("snapshot_old"), r("snapshot_new")), r("snapshot_new")), "SELECT path, is_dir, len, modified FROM {snapshot_new} WHERE path NOT IN (SELECT a.path FROM {snapshot_old} a JOIN {snapshot_new} b ON a.path = b.path WHERE a.is_dir AND b.is_dir) UNION ALL SELECT a.path, a.is_dir, a.len, a.modified FROM {snapshot_old} a JOIN {snapshot_new} b ON a.path = b.path WHERE a.is_dir AND b.is_dir"),
    # Sessions
    "pair_requests": (exchanges, EXCHANGES),
    "latency_stats": (lambda r: ses.latency_stats(exchanges(r)), f"SELECT method, count(*) AS answered, min(latency_ms) AS least, list_sort(list(latency_ms))[count(*) // 2 + 1] AS median, max(latency_ms) AS most FROM ({EXCHANGES}) WHERE latency_ms IS NOT NULL GROUP BY method"),
    "notification_counts": (lambda r: ses.notification_counts(r("log_message")), "SELECT sender, method, count(*) AS n FROM {log_message} WHERE kind = 'notification' GROUP BY sender, method"),
    "document_sync_pivot": (
        lambda r: ses.document_sync_pivot(synced(r)),
        """SELECT concat('file:///u', user_id) AS uri, count(*) FILTER (WHERE event_type = 'signup') AS "didOpen", count(*) FILTER (WHERE event_type = 'view') AS "didChange", CAST(0 AS BIGINT) AS "didSave",
             count(*) FILTER (WHERE event_type = 'error') AS "didClose" FROM {events} WHERE event_type IN ('signup', 'view', 'error') AND event_id % 3 <> 0 GROUP BY user_id""",
    ),
    "answers_by_method": (lambda r: ses.answers_by_method(exchanges(r)), f"SELECT method, list(answer ORDER BY pos) AS answers FROM (SELECT method, answer, min(pos) AS pos FROM ({EXCHANGES}) WHERE answer IS NOT NULL GROUP BY ALL) GROUP BY method"),
    "first_answers": (lambda r: ses.first_answers(exchanges(r)), f"SELECT method, answer, min(pos) AS pos FROM ({EXCHANGES}) WHERE answer IS NOT NULL GROUP BY method, answer"),
    "step_bounds": (lambda r: ses.step_bounds(r("mark")), "SELECT ts_ms, step, lead(ts_ms, 1, 9223372036854775807) OVER (ORDER BY ts_ms, step) AS end_ms FROM {mark}"),
    "assign_step": (lambda r: ses.assign_step(r("log_message"), r("mark")).select("pos", "step"), f"SELECT pos, step FROM ({STEPPED})"),
    "step_summary": (
        lambda r: ses.step_summary(stepped_messages(r), r("mark")),
        f"""SELECT m.step,
             coalesce((SELECT string_agg(concat(replace(method, 'textDocument/', ''), ' ', uri), ', ' ORDER BY pos) FROM ({STEP_MESSAGES}) x WHERE x.step = m.step AND sync), 'none') AS sync,
             coalesce((SELECT string_agg(method, ', ' ORDER BY pos) FROM (SELECT step, method, min(pos) AS pos FROM ({STEP_MESSAGES}) WHERE NOT sync AND kind = 'request' GROUP BY step, method) x WHERE x.step = m.step), 'none') AS requests,
             coalesce((SELECT string_agg(method, ', ' ORDER BY pos) FROM (SELECT step, method, min(pos) AS pos FROM ({STEP_MESSAGES}) WHERE NOT sync AND kind = 'notification' GROUP BY step, method) x WHERE x.step = m.step), 'none') AS notifications
           FROM (SELECT step FROM {{mark}} UNION SELECT 'startup') m""",
    ),
    "gap_verdicts": (lambda r: ses.gap_verdicts(exchanges(r).withColumn("answer", F.when(F.col("method").endswith("m1"), "error -32601").when(~F.col("method").endswith("m2"), F.col("answer")))), f"SELECT method, CASE WHEN method LIKE '%m2' THEN 'NOT OBSERVED' WHEN method LIKE '%m1' THEN 'CONFIRMED' WHEN count(answer) = 0 THEN 'NOT OBSERVED' ELSE 'REFUTED' END AS verdict FROM ({EXCHANGES}) GROUP BY method"),
    "session_summary": (lambda r: ses.session_summary(r("log_message")), "SELECT sender, count(*) AS messages, count(*) FILTER (WHERE kind = 'request') AS requests, CAST(sum(bytes) AS BIGINT) AS bytes FROM {log_message} GROUP BY sender"),
    # Facets
    "facet_eq": (lambda r: fac.select_items(r("tag"), fac.facet_eq("flag", "A") & fac.facet_eq("brand", "Brand#2")), "SELECT item FROM {tag} GROUP BY item HAVING bool_or(key = 'flag' AND value = 'A') AND bool_or(key = 'brand' AND value = 'Brand#2')"),
    "facet_algebra": (lambda r: fac.select_items(r("tag"), FLAG), FLAG_SQL),
    "facet_has_ne": (lambda r: fac.select_items(r("tag"), fac.facet_has("flag") & fac.facet_ne("flag", "A") & fac.facet_lt("size", 20)), "SELECT item FROM {tag} GROUP BY item HAVING bool_or(key = 'flag') AND bool_or(key = 'flag' AND value <> 'A') AND bool_or(key = 'size' AND TRY_CAST(value AS DOUBLE) < 20)"),
    "facet_counts": (lambda r: fac.facet_counts(r("tag")), "SELECT key, count(DISTINCT item) AS items, count(DISTINCT value) AS values FROM {tag} GROUP BY key"),
    "notify": (lambda r: fac.notify(r("tag"), [("a", fac.facet_eq("flag", "N")), ("b", fac.facet_gt("size", 45))]), "SELECT DISTINCT 'a' AS consumer, item FROM {tag} WHERE key = 'flag' AND value = 'N' UNION ALL SELECT DISTINCT 'b', item FROM {tag} WHERE key = 'size' AND TRY_CAST(value AS DOUBLE) > 45"),
    # Graph views and tags
    "derive_facets": (lambda r: gv.derive_facets(r("file"), r("symbol"), r("call_site")), "SELECT * FROM (SELECT concat('file:', path) AS item, 'lang' AS key, language AS value FROM {file} UNION ALL SELECT concat('file:', path), 'dir', 'src' FROM {file} UNION ALL SELECT concat('sym:', id), 'kind', kind FROM {symbol} UNION ALL SELECT concat('sym:', id), 'module', module FROM {symbol} UNION ALL SELECT concat('sym:', id), 'file', file FROM {symbol} UNION ALL SELECT concat('site:', site_id), 'caller', caller FROM {call_site} UNION ALL SELECT concat('site:', site_id), 'target', declared_target FROM {call_site} UNION ALL SELECT concat('site:', site_id), 'dispatch', dispatch FROM {call_site}) WHERE value IS NOT NULL"),
    "module_edges": (graph, GRAPH),
    "module_drilldown": (lambda r: gv.module_drilldown(edges(r), "parts.Brand#1"), f"SELECT CASE WHEN from_module = 'parts.Brand#1' THEN caller ELSE from_module END AS source, CASE WHEN to_module = 'parts.Brand#1' THEN target ELSE to_module END AS sink, count(DISTINCT site_id) AS calls, bool_and(method = 'lsp-impl') AS expansion_only FROM ({EDGES}) WHERE from_module = 'parts.Brand#1' OR to_module = 'parts.Brand#1' GROUP BY ALL"),
    "collapse_modules": (lambda r: gv.collapse_modules(graph(r), 1), f"SELECT string_split(from_module, '.')[1] AS from_module, string_split(to_module, '.')[1] AS to_module, CAST(sum(calls) AS BIGINT) AS calls FROM ({GRAPH}) GROUP BY 1, 2 HAVING string_split(from_module, '.')[1] <> string_split(to_module, '.')[1]".replace("GROUP BY 1, 2 HAVING string_split(from_module, '.')[1] <> string_split(to_module, '.')[1]", "WHERE string_split(from_module, '.')[1] <> string_split(to_module, '.')[1] GROUP BY 1, 2")),
    "result_set_callgraph": (lambda r: gv.result_set_callgraph(edges(r), fac.select_items(r("tag"), FLAG).select(F.col("item").alias("id"))), f"SELECT CASE WHEN c.item IS NOT NULL THEN caller ELSE from_module END AS source, CASE WHEN t.item IS NOT NULL THEN target ELSE to_module END AS sink, count(DISTINCT site_id) AS calls FROM ({EDGES}) e LEFT JOIN ({FLAG_SQL}) c ON c.item = caller LEFT JOIN ({FLAG_SQL}) t ON t.item = target WHERE c.item IS NOT NULL OR t.item IS NOT NULL GROUP BY ALL"),
    "heaviest_edges": (lambda r: gv.heaviest_edges(graph(r), 10), f"SELECT * FROM ({GRAPH}) ORDER BY calls DESC, from_module, to_module LIMIT 10"),
    "elided_edges": (lambda r: gv.elided_edges(graph(r), 10), f"SELECT (SELECT count(*) FROM ({GRAPH})) - 10 AS edges, CAST((SELECT sum(calls) FROM ({GRAPH})) - (SELECT sum(calls) FROM (SELECT calls FROM ({GRAPH}) ORDER BY calls DESC, from_module, to_module LIMIT 10)) AS BIGINT) AS calls"),
    "skeleton_rows": (lambda r: gv.skeleton_rows(r("symbol"), r("call_site"), r("call_target")).select("site_id", "ordinal", "target", "also"), "SELECT s.site_id, CAST(ordinal AS INT) AS ordinal, t.target, coalesce(k > 1, FALSE) AS also FROM (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY line, col, site_id) AS ordinal FROM {call_site}) s JOIN {symbol} y ON y.id = s.caller LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY target, method) AS k FROM {call_target}) t ON t.site_id = s.site_id"),
    "site_card": (
        lambda r: gv.site_card(r("call_site"), r("call_target"), r("call_site").where("dispatch = 'virtual'").select("site_id")),
        "SELECT s.site_id, s.caller, s.declared_target, t.target, t.method FROM {call_site} s LEFT JOIN {call_target} t ON t.site_id = s.site_id WHERE s.dispatch = 'virtual'",
    ),
    "symbol_card": (lambda r: gv.symbol_card(edges(r), r("part").where("p_size = 5").select(F.concat(F.lit("part:"), "p_partkey").alias("id"))), f"SELECT * FROM (SELECT caller AS id, 'calls' AS direction, target AS other, count(DISTINCT site_id) AS sites FROM ({EDGES}) GROUP BY caller, target UNION ALL SELECT target, 'called-by', caller, count(DISTINCT site_id) FROM ({EDGES}) GROUP BY caller, target) WHERE id IN (SELECT concat('part:', p_partkey) FROM {{part}} WHERE p_size = 5)"),
    "orphan_tags": (lambda r: gv.orphan_tags(r("tag"), r("part").where("p_size > 3").select(F.concat(F.lit("part:"), "p_partkey").alias("item"))), "SELECT item, key, value FROM {tag} WHERE item NOT IN (SELECT concat('part:', p_partkey) FROM {part} WHERE p_size > 3)"),
    "apply_tag_ops": (lambda r: gv.apply_tag_ops(tags3(r, "FALSE"), r("part").where("p_size = 11").select(F.lit("tag").alias("op"), F.concat(F.lit("sym:p"), "p_partkey").alias("item"), F.lit("extra").alias("arg")).union(r("part").where("p_size = 12").select(F.lit("untag"), F.concat(F.lit("sym:p"), "p_partkey"), F.col("p_type"))).union(r("part").where("p_size = 13").select(F.lit("mv"), F.concat(F.lit("sym:p"), "p_partkey"), F.concat(F.lit("sym:moved/p"), "p_partkey")))), f"SELECT DISTINCT CASE WHEN p_size = 13 THEN concat('sym:moved/p', p_partkey) ELSE item END AS item, tag FROM (SELECT concat('sym:p', p_partkey) AS item, p_partkey, p_size, unnest([p_type, p_brand, CASE WHEN p_size = 11 THEN 'extra' ELSE p_brand END]) AS tag, p_type FROM {{part}}) WHERE NOT (p_size = 12 AND tag = p_type)"),
    "merge_tags": (lambda r: gv.merge_tags(tags3(r, "FALSE"), tags3(r, "p_size % 4 = 0"), tags3(r, "p_size % 6 = 0")), MERGE),
    "union_call_edges": (union_call_edges, "SELECT *, count(*) OVER (PARTITION BY site_id, method) AS candidates FROM (SELECT s.site_id, e.declared_target AS target, 'vta' AS method FROM {call_site} s JOIN {call_site} e ON e.file = s.file AND e.line = s.line AND e.col = s.col AND e.col % 2 = 0 UNION SELECT s.site_id, y.id, 'name-match' FROM {call_site} s JOIN {symbol} y ON string_split(y.name, '.')[-1] = concat('o', s.line * 7) WHERE s.col % 5 = 1)"),
    "name_candidates": (lambda r: gv.name_candidates(r("call_site").select("site_id", F.concat(F.lit("o"), F.col("line") * 7).alias("name")), r("symbol")), "SELECT s.site_id, concat('o', s.line * 7) AS name, y.n AS candidates FROM {call_site} s JOIN (SELECT string_split(name, '.')[-1] AS name, count(DISTINCT id) AS n FROM {symbol} GROUP BY 1) y ON y.name = concat('o', s.line * 7)"),
    "change_facets": (lambda r: gv.change_facets(chg.snapshot_diff(r("snapshot_old"), r("snapshot_new"))), "SELECT concat('file:', path) AS item, k AS key, CASE k WHEN 'change' THEN kind ELSE string_split(path, '/')[1] END AS value FROM (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'created' WHEN b.path IS NULL THEN 'deleted' WHEN a.is_dir <> b.is_dir OR NOT b.is_dir AND (a.len <> b.len OR a.modified <> b.modified) THEN 'changed' END AS kind FROM {snapshot_old} a FULL JOIN {snapshot_new} b ON a.path = b.path), (VALUES ('change'), ('dir')) AS v(k) WHERE kind IS NOT NULL"),
    # Syntax context
    "control_context": (lambda r: syn.control_context(sites_at(r), nodes(r), r("control_kind"), ("function_item",)).select("site_id", F.array_join("controls", ",").alias("controls")), f"""SELECT s.site_id, coalesce(string_agg(k.control, ',' ORDER BY n.start DESC, n.end_at, n.node_id), '') AS controls FROM ({SITES_AT}) s LEFT JOIN (SELECT * FROM (SELECT s.site_id, n.start AS def_start, n.end_at AS def_end, row_number() OVER (PARTITION BY s.site_id ORDER BY n.start DESC, n.end_at) AS k FROM ({SITES_AT}) s JOIN {{node}} n ON n.file = s.file AND n.start <= at_ AND at_ < n.end_at AND n.kind = 'function_item') WHERE k = 1) d ON d.site_id = s.site_id
      LEFT JOIN (SELECT n.*, k.control FROM {{node}} n JOIN {{control_kind}} k ON k.kind = n.kind) n ON n.file = s.file AND n.start <= at_ AND at_ < n.end_at AND (def_start IS NULL OR n.start > def_start OR n.start = def_start AND n.end_at < def_end) LEFT JOIN {{control_kind}} k ON k.kind = n.kind GROUP BY s.site_id"""),
    "site_call": (lambda r: syn.site_call(sites_at(r), nodes(r), ("call_expression",)), f"SELECT site_id, call FROM (SELECT s.site_id, n.node_id AS call, row_number() OVER (PARTITION BY s.site_id ORDER BY n.start DESC, n.end_at, n.node_id DESC) AS k FROM ({SITES_AT}) s JOIN {{node}} n ON n.file = s.file AND n.start <= at_ AND at_ < n.end_at AND n.kind = 'call_expression') WHERE k = 1"),
    "resolution_lines": (
        lambda r: reg.resolution_lines(res.resolution_rollup(by_module(r))),
        f"""SELECT concat(CASE WHEN g = 1 THEN 'total' ELSE coalesce(language, 'unknown') END, ' ', n, ' ', u, ' ', printf('%.1f', u / n * 100), '%') AS line
  FROM (SELECT grouping(language) AS g, language, CAST(sum(call_sites) AS BIGINT) AS n, CAST(sum(unresolved) AS BIGINT) AS u FROM ({BY_MODULE}) GROUP BY ROLLUP (language))""",
    ),
    "site_call_in_callee": (
        lambda r: syn.site_call(sites_at(r), nodes(r), ("call_expression",), callees(r)),
        f"""SELECT site_id, call FROM (SELECT s.site_id, n.node_id AS call, at_ < n.start + 300 AS named, row_number() OVER (PARTITION BY s.site_id ORDER BY n.start DESC, n.end_at, n.node_id DESC) AS k
  FROM ({SITES_AT}) s JOIN {{node}} n ON n.file = s.file AND n.start <= at_ AND at_ < n.end_at AND n.kind = 'call_expression') WHERE k = 1 AND named""",
    ),
    "literal_arguments": (
        lambda r: syn.literal_arguments(r("orders").where("o_orderkey % 5 <> 2").select(F.col("o_orderkey").alias("call")), arguments(r), ("string",), ("interpolation",)).select("call", F.array_join("literals", ",").alias("literals")),
        """SELECT l_orderkey AS call, string_agg(CASE WHEN l_returnflag = 'A' THEN concat('it', chr(39), 's ', l_partkey) ELSE concat('part ', l_partkey) END, ',' ORDER BY site_id) AS literals
  FROM {line} WHERE l_orderkey % 5 <> 2 AND l_linestatus = 'F' AND l_tax >= 0.03 GROUP BY l_orderkey""",
    ),
}


def _query(build):
    return lambda spark, sf_dir: build(lambda name, given=None, text=None: relation(spark, sf_dir, name, given, text))


def queries() -> dict:
    return {name: _query(build) for name, (build, _) in (ENTRIES | round_trips.ENTRIES | change_streams.ENTRIES | tag_files.ENTRIES | reports.ENTRIES | details.ENTRIES).items()}


def oracle_sql() -> dict:
    return {name: oracle(sql) for name, (_, sql) in ENTRIES.items() if sql} | round_trips.oracle_sql() | change_streams.oracle_sql() | tag_files.oracle_sql() | reports.oracle_sql() | details.oracle_sql()
