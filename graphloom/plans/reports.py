"""Registered queries of reports: documents in sorted parts, verdicts on sessions, and places in whole files."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.functions.frames import checkpointed, dealer
from graphloom.operators import regressions, resolution, sessions
from graphloom.plans.inputs import lines_once, oracle
from graphloom.plans.round_trips import folder
from graphloom.sources import reports

#: The generations that the report compares, and the one whose counts are its baseline.
NOW, BEFORE, BASELINE = 1998, 1997, 1999


def of_year(r, y):
    return r("edges_by_year").where(F.col("generation") == y).drop("generation")


def by_module(r):
    """resolution_by_module of an `r` of lines_once. Sites and targets are dealt by site in tasks of bounded rows,
    and so are files and symbols, which sums of sites then meet."""
    deal = dealer(r("line"))
    return resolution.resolution_by_module(*[deal(r(name), key) for name, key in (("call_site", "site_id"), ("call_target", "site_id"), ("file", "path"), ("symbol", "id"))])


def report_lines(r):
    """Sums by module and edge counts are read many times over, so they are written."""
    modules, edges = checkpointed(by_module(lines_once(r))), checkpointed(r("edges_by_year"))
    read, r = r, lambda name: edges if name == "edges_by_year" else read(name)
    figures = [F.sum(c).alias(c) for c in ("call_sites", "resolved", "unresolved")]
    paths = r("supplier").where("s_suppkey % 9 <> 4").select(F.concat(F.lit("src/s"), "s_suppkey", F.lit(".rs")).alias("path"))
    drops = regressions.edge_regressions(of_year(r, BEFORE), of_year(r, NOW), paths)
    return reports.report_lines(NOW, modules, modules.groupBy("language").agg(*figures), modules.agg(*figures), BEFORE, drops, regressions.edge_diff(of_year(r, BASELINE), of_year(r, NOW)), of_year(r, NOW))


def report_document(r):
    """The report, written in order and read back: its lines, without their commas' places in the file."""
    spark, to = r("region").sparkSession, folder(r, "report")
    reports.write_document(report_lines(r), to)
    return spark.read.text(to).select(F.col("value").alias("line"))


def baseline_document(r):
    spark, to = r("region").sparkSession, folder(r, "baseline-lines")
    reports.write_document(reports.baseline_lines(of_year(r, NOW)), to)
    return spark.read.text(to).select(F.col("value").alias("line"))


RESOLVED = "SELECT f.language, y.package, y.module, s.resolved FROM (SELECT s.*, EXISTS (SELECT 1 FROM {call_target} t WHERE t.site_id = s.site_id AND t.method <> 'name-match') AS resolved FROM {call_site} s) s LEFT JOIN {file} f ON f.path = s.file LEFT JOIN {symbol} y ON y.id = s.caller"
FIGURES = "'call_sites', count(*), 'resolved', count(*) FILTER (WHERE resolved), 'unresolved', count(*) FILTER (WHERE NOT resolved), 'unresolved_rate', round(count(*) FILTER (WHERE NOT resolved) / count(*), 6)"
YEAR = lambda y: f"(SELECT provider, path, edge_count FROM {{edges_by_year}} WHERE generation = {y})"
DROPS = f"""SELECT p.provider, p.path, p.edge_count AS previous, c.edge_count AS current FROM {YEAR(BEFORE)} p LEFT JOIN {YEAR(NOW)} c USING (provider, path) LEFT JOIN (SELECT concat('src/s', s_suppkey, '.rs') AS path FROM {{supplier}} WHERE s_suppkey % 9 <> 4) x ON x.path = p.path
  WHERE CASE WHEN c.edge_count IS NULL THEN p.edge_count > 0 AND x.path IS NOT NULL WHEN p.edge_count <= 0 THEN FALSE WHEN c.edge_count <= 0 THEN TRUE ELSE (p.edge_count - c.edge_count) * 100 > p.edge_count * 50 END"""
DIFFS = f"SELECT coalesce(a.provider, b.provider) AS provider, coalesce(a.path, b.path) AS path, a.edge_count AS expected, b.edge_count AS found FROM {YEAR(BASELINE)} a FULL JOIN {YEAR(NOW)} b USING (provider, path) WHERE a.edge_count IS DISTINCT FROM b.edge_count"


def listed(rows: str, order: str) -> str:
    """Rows of one JSON column `o` as lines, with a comma before all but the first."""
    return f"SELECT concat(CASE WHEN row_number() OVER (ORDER BY {order}) = 1 THEN '' ELSE ',' END, o) AS line FROM ({rows})"


EDGES = f"""SELECT concat(CASE WHEN row_number() OVER (ORDER BY provider) = 1 THEN '' ELSE ',' END, '"', provider, '":{{{{') AS line FROM (SELECT DISTINCT provider FROM {YEAR(NOW)}) UNION ALL SELECT '}}}}' FROM (SELECT DISTINCT provider FROM {YEAR(NOW)})
  UNION ALL SELECT concat(CASE WHEN row_number() OVER (PARTITION BY provider ORDER BY path) = 1 THEN '' ELSE ',' END, '"', path, '":', edge_count) FROM {YEAR(NOW)}""".replace("{{", "{").replace("}}", "}")
REPORT = " UNION ALL ".join([
    f"""SELECT unnest(['{{"generation":{NOW},', '"modules":[', '],"languages":[', '],"total":', ',"regression":{{"previous":{BEFORE},"threshold_percent":50,"drops":[', ']}},"baseline":{{"differences":[', ']}},"edge_counts":{{', '}}}}']) AS line""",
    listed(f"SELECT language, package, module, json_object('language', language, 'package', package, 'module', module, {FIGURES}) AS o FROM ({RESOLVED}) GROUP BY language, package, module", "language NULLS FIRST, package NULLS FIRST, module NULLS FIRST"),
    listed(f"SELECT language, json_object('language', language, {FIGURES}) AS o FROM ({RESOLVED}) GROUP BY language", "language NULLS FIRST"), f"SELECT CAST(json_object({FIGURES}) AS VARCHAR) FROM ({RESOLVED})",
    listed(f"SELECT provider, path, json_object('provider', provider, 'path', path, 'previous', previous, 'current', current) AS o FROM ({DROPS})", "provider, path"),
    listed(f"SELECT provider, path, json_object('provider', provider, 'path', path, 'expected', expected, 'found', found) AS o FROM ({DIFFS})", "provider, path"), EDGES,
])

VERDICTS = """WITH m AS (SELECT *, CAST(msg AS JSON) AS j FROM {session_message}), s AS (SELECT DISTINCT session FROM m),
  i AS (SELECT s.session, x.j, json_type(x.j, '$.params.capabilities.workspace.didChangeWatchedFiles') AS w, json_type(x.j, '$.params.rootUri') AS u FROM s LEFT JOIN (SELECT session, arg_min(j, pos) AS j FROM m WHERE sender = 'client' AND method = 'initialize' GROUP BY session) x USING (session)),
  q AS (SELECT a.session, a.method, count(*) AS n, count(*) FILTER (WHERE (SELECT arg_min(json_extract_string(b.j, '$.error.code'), b.pos) FROM m b WHERE b.session = a.session AND b.id = a.id AND b.sender = 'client' AND b.kind = 'response' ) = '-32601') AS k FROM m a WHERE a.kind = 'request' AND a.sender = 'server' GROUP BY a.session, a.method),
  d AS (SELECT session, count(*) AS n, count(*) FILTER (WHERE c > o) AS k FROM (SELECT session, json_extract_string(j, '$.params.textDocument.uri') AS uri, min(pos) FILTER (WHERE method = 'textDocument/didOpen') AS o, max(pos) FILTER (WHERE method = 'textDocument/didChange') AS c FROM m WHERE method LIKE 'textDocument/did%' GROUP BY session, uri) WHERE o IS NOT NULL GROUP BY session)
  SELECT session, 'workspace.didChangeWatchedFiles' AS "check", CASE WHEN j IS NULL THEN 'NOT OBSERVED' WHEN w IS NULL THEN 'CONFIRMED' ELSE 'REFUTED' END AS verdict, CASE WHEN j IS NULL THEN 'no initialize' WHEN w IS NULL THEN 'absent' ELSE CAST(json_extract(j, '$.params.capabilities.workspace.didChangeWatchedFiles') AS VARCHAR) END AS detail FROM i
  UNION ALL SELECT session, 'rootUri', CASE WHEN j IS NULL THEN 'NOT OBSERVED' WHEN u IS NULL OR u = 'NULL' THEN 'CONFIRMED' ELSE 'REFUTED' END, CASE WHEN j IS NULL THEN 'no initialize' WHEN u IS NULL THEN 'absent' ELSE CAST(json_extract(j, '$.params.rootUri') AS VARCHAR) END FROM i
  UNION ALL SELECT s.session, c.method, CASE WHEN n IS NULL THEN 'NOT OBSERVED' WHEN n = k THEN 'CONFIRMED' ELSE 'REFUTED' END, CASE WHEN n IS NOT NULL THEN concat(k, ' of ', n) END FROM s CROSS JOIN (VALUES ('client/registerCapability'), ('window/workDoneProgress/create'), ('workspace/configuration')) c(method) LEFT JOIN q ON q.session = s.session AND q.method = c.method
  UNION ALL SELECT s.session, 'didChange after didOpen', CASE WHEN n IS NULL THEN 'NOT OBSERVED' WHEN k = 0 THEN 'CONFIRMED' ELSE 'REFUTED' END, CASE WHEN n IS NOT NULL THEN concat(k, ' of ', n) END FROM s LEFT JOIN d USING (session)"""


def wide_lines(r):
    """Documents as files; every third begins with a character of two UTF-16 units."""
    return text.line_offsets(r("source_line").select(F.col("doc_id").alias("path"), F.concat(F.when(F.col("doc_id") % 3 == 0, "\U0001f600").otherwise(""), "text").alias("text")))


def byte_offset(r):
    """A place in the middle of every line, and one in the middle of that first character."""
    lines = wide_lines(r)
    places = lines.select("path", "line", F.explode(F.array(F.lit(1), F.floor(F.length("text") / 2).cast("int") + 2)).alias("column"))
    return text.byte_offset(lines, places, "utf-16").select("path", "line", "column", "byte")


PLACES = """WITH t AS (SELECT doc_id AS path, string_split(concat(CASE WHEN doc_id % 3 = 0 THEN '\U0001f600' ELSE '' END, text), chr(10)) AS ls FROM {source_line}), l AS (SELECT path, i - 1 AS line, ls[i] AS s, list_sum(list_transform(ls[1:i - 1], lambda x: strlen(x) + 1)) AS before, i = 1 AND path % 3 = 0 AS wide FROM (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i FROM t)),
  p AS (SELECT *, unnest([1, length(s) // 2 + 2]) AS col FROM l) SELECT path, CAST(line AS INT) AS line, CAST(col AS INT) AS "column",
    CASE WHEN col <= length(s) + CASE WHEN wide THEN 1 ELSE 0 END AND NOT (wide AND col = 1) THEN coalesce(before, 0) + strlen(substr(s, 1, col - CASE WHEN wide THEN 1 ELSE 0 END)) END AS byte FROM p""".replace("\\U0001f600", "\U0001f600")

ENTRIES = {
    "report_json": (report_document, REPORT),
    "baseline_document": (baseline_document, f"SELECT '{{' AS line UNION ALL SELECT '}}' UNION ALL {EDGES}"),
    "session_verdicts": (lambda r: sessions.session_verdicts(r("session_message")), VERDICTS),
    "byte_offset": (byte_offset, PLACES),
}


def oracle_sql() -> dict:
    return {name: oracle(sql) for name, (_, sql) in ENTRIES.items() if sql}
