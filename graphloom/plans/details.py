"""Registered queries of details: hashes and suffixes of names, fields of control kinds, lists behind counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import graph_views, names, resolution, syntax_context
from graphloom.plans.inputs import lines_once, oracle


def hashed(id_: str, attempt: str) -> str:
    """SQL for the 24-bit hash of an ASCII id: FNV-1a over its bytes, and those of an attempt over 0."""
    codes = f"list_concat(list_transform(string_split({id_}, ''), lambda x: CAST(ascii(x) AS HUGEINT)), CASE WHEN {attempt} > 0 THEN [CAST(255 AS HUGEINT), {attempt}, 0, 0, 0] ELSE [] END)"
    h = f"list_reduce(list_concat([CAST(14695981039346656037 AS HUGEINT)], {codes}), lambda h, b: xor(h, b) * CAST(1099511628211 AS HUGEINT) % CAST(18446744073709551616 AS HUGEINT))"
    return f"(SELECT printf('%06x', CAST(xor(xor(h, h // 16777216), h // 281474976710656) % 16777216 AS BIGINT)) FROM (SELECT {h} AS h))"


def dir_entries(r):
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return r("part").select(F.col("p_brand").alias("dir"), F.concat(name, (F.col("p_partkey") % 40).cast("string")).alias("name"), F.concat(F.lit("part:"), "p_partkey").alias("id"))


#: No suffixed name clashes again in these tables, so the first attempt decides.
SUFFIXED = f"""SELECT dir, name, id, CASE WHEN count(*) OVER (PARTITION BY dir, lower(name)) > 1 THEN concat(name, '~', {hashed("id", "0")}) ELSE name END AS final
  FROM (SELECT p_brand AS dir, concat(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END, p_partkey % 40) AS name, concat('part:', p_partkey) AS id FROM {{part}})"""


def sites(r):
    return r("line").select("site_id", F.concat(F.lit("c"), "o_custkey").alias("file"), (F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")) * 10).cast("long").alias("at"))


def control_fields(r):
    kinds = r("control_kind").withColumn("mode", F.when(F.col("kind") == "if_expression", "only").otherwise("except")).withColumn("fields", F.array(F.lit("body")))
    return syntax_context.control_context(sites(r), r("linked_node"), kinds, ("function_item",)).select("site_id", F.array_join("controls", ",").alias("controls"))


AROUND = "SELECT s.site_id, n.node_id, n.kind, n.start, n.end_at, n.parent_id, n.field FROM (SELECT site_id, concat('c', o_custkey) AS file, CAST(datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) * 10 AS BIGINT) AS at_ FROM {line}) s JOIN {linked_node} n ON n.file = s.file AND n.start <= at_ AND at_ < n.end_at"
CONTROLS = f"""WITH a AS ({AROUND}), d AS (SELECT site_id, max(start) AS ds, min(end_at) AS de FROM (SELECT *, rank() OVER (PARTITION BY site_id ORDER BY start DESC) AS k FROM a WHERE kind = 'function_item') WHERE k = 1 GROUP BY site_id),
  c AS (SELECT a.*, k.control, w.field AS entered FROM a JOIN {{control_kind}} k ON k.kind = a.kind LEFT JOIN d ON d.site_id = a.site_id LEFT JOIN a w ON w.site_id = a.site_id AND w.parent_id = a.node_id WHERE ds IS NULL OR a.start > ds OR a.start = ds AND a.end_at < de)
  SELECT s.site_id, coalesce(string_agg(control, ',' ORDER BY c.start DESC, c.end_at, c.node_id), '') AS controls FROM {{line}} s LEFT JOIN (SELECT * FROM c WHERE CASE WHEN kind = 'if_expression' THEN coalesce(entered = 'body', FALSE) ELSE NOT coalesce(entered = 'body', FALSE) END) c ON c.site_id = s.site_id GROUP BY s.site_id"""

#: A message's `init` as in sessions: what its paths hold.
PRESENT = "SELECT session, pos, CASE WHEN t IS NULL THEN 'absent' WHEN t = 'NULL' THEN 'null' ELSE 'present' END AS root FROM (SELECT session, pos, json_type(CAST(msg AS JSON), '$.params.rootUri') AS t FROM {session_message})"
UNRESOLVED = """SELECT s.site_id, y.module, s.file, s.line, s.caller, s.declared_target, s.dispatch, coalesce(n, 0) AS candidates FROM {call_site} s JOIN {symbol} y ON y.id = s.caller LEFT JOIN (SELECT site_id, count(*) AS n, bool_or(method <> 'name-match') AS known FROM {call_target} GROUP BY site_id) t ON t.site_id = s.site_id
  WHERE y.module IS NOT NULL AND NOT coalesce(known, FALSE)"""
FACETS = """SELECT DISTINCT item, key, value FROM (SELECT concat('site:', site_id) AS item, k AS key, CASE k WHEN 'kind' THEN 'callsite' WHEN 'line' THEN CAST(line AS VARCHAR) WHEN 'file' THEN s.file ELSE y.module END AS value FROM {call_site} s LEFT JOIN {symbol} y ON y.id = s.caller, (VALUES ('kind'), ('line'), ('file'), ('module')) v(k)
  UNION ALL SELECT concat('site:', s.site_id), k, CASE k WHEN 'target' THEN t.target ELSE t.method END FROM {call_site} s JOIN {call_target} t ON t.site_id = s.site_id, (VALUES ('target'), ('prov:method')) v(k)
  UNION ALL SELECT concat('sym:', s.caller), 'calls', t.target FROM {call_site} s JOIN {call_target} t ON t.site_id = s.site_id) WHERE value IS NOT NULL"""

ENTRIES = {
    "fnv24": (lambda r: r("part").select("p_partkey", names.fnv24(F.concat(F.lit("part:"), "p_partkey"), (F.col("p_partkey") % 3).cast("int")).alias("hash")), f"SELECT p_partkey, {hashed('id', 'attempt')} AS hash FROM (SELECT p_partkey, concat('part:', p_partkey) AS id, p_partkey % 3 AS attempt FROM {{part}})"),
    "case_fold_suffixes": (lambda r: names.case_fold_suffixes(dir_entries(r)), SUFFIXED),
    "control_context_fields": (control_fields, CONTROLS),
    "json_presence": (lambda r: r("session_message").select("session", "pos", text.json_presence(F.col("msg"), "params.rootUri").alias("root")), PRESENT),
    "unresolved_list": (lambda r: resolution.unresolved_list(r("call_site"), r("call_target"), r("symbol")), UNRESOLVED),
    "derive_call_facets": (lambda r: graph_views.derive_call_facets(*map(lines_once(r), ("call_site", "call_target", "symbol"))), FACETS),
}


def oracle_sql() -> dict:
    return {name: oracle(sql) for name, (_, sql) in ENTRIES.items() if sql}
