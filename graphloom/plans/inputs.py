"""Input relations of the registered queries, as SQL over the driver's tables that Spark and DuckDB both run.

`{name}` stands for another relation or a table of the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from graphloom.functions.frames import checkpointed, dealer

TABLES = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

RELATIONS = {
    "line": """SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS site_id,
        {lineitem}.*, o_custkey FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "call_site": """SELECT site_id, CAST(1 AS INT) AS run_id, concat('order:', l_orderkey) AS caller, concat('src/c', o_custkey, '.rs') AS file,
        CAST(l_linenumber AS INT) AS line, CAST(l_quantity AS INT) AS col, CASE WHEN l_tax < 0.04 THEN 'call' ELSE 'value' END AS ref_kind,
        concat('part:', l_partkey) AS declared_target, CASE WHEN l_linestatus = 'F' THEN 'static' ELSE 'virtual' END AS dispatch FROM {line}""",
    "call_target": """SELECT site_id, concat('part:', l_partkey) AS target, CASE WHEN l_returnflag = 'A' THEN 'name-match' ELSE 'declared' END AS method FROM {line} WHERE l_returnflag <> 'R'
        UNION ALL SELECT site_id, concat('part:', l_partkey + 1) AS target, 'name-match' AS method FROM {line} WHERE l_returnflag = 'A' AND l_quantity > 25""",
    "file": """SELECT concat('src/c', c_custkey, '.rs') AS path, CASE WHEN c_nationkey % 7 = 0 THEN NULL ELSE r_name END AS language, c_name AS content_hash, CAST(c_nationkey * 10 AS BIGINT) AS size
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey WHERE c_custkey % 11 <> 3""",
    "symbol": """SELECT concat('order:', o_orderkey) AS id, concat('shop.', o_orderpriority, '.o', o_orderkey % 5000) AS name, 'function' AS kind, concat('src/c', o_custkey, '.rs') AS file,
          CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat('shop.', o_orderpriority) END AS module, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END AS package FROM {orders}
        UNION ALL SELECT concat('part:', p_partkey) AS id, concat('parts.', p_brand, '.', p_name) AS name, CASE WHEN p_size % 3 = 0 THEN 'trait_method' ELSE 'method' END AS kind, concat('src/p', p_partkey % 50, '.rs') AS file,
          CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE concat('parts.', p_brand) END AS module, p_type AS package FROM {part}""",
    "run": """SELECT CAST(y AS INT) AS run_id, CASE WHEN y % 2 = 0 THEN 'rust' ELSE 'go' END AS provider, 'succeeded' AS status FROM (SELECT DISTINCT year(l_shipdate) AS y FROM {lineitem}) AS t""",
    "run_file": """SELECT CAST(year(l_shipdate) AS INT) AS run_id, concat('src/s', l_suppkey, '.rs') AS path, count(*) AS edge_count FROM {lineitem} GROUP BY year(l_shipdate), l_suppkey""",
    "edges_by_year": """SELECT CAST(year(l_shipdate) AS BIGINT) AS generation, CASE WHEN l_suppkey % 2 = 0 THEN 'rust' ELSE 'go' END AS provider, concat('src/s', l_suppkey, '.rs') AS path,
        CASE WHEN (l_suppkey + year(l_shipdate)) % 5 = 0 THEN count(*) ELSE count(*) * 3 END AS edge_count FROM {lineitem} WHERE (l_suppkey + year(l_shipdate)) % 7 <> 0 GROUP BY year(l_shipdate), l_suppkey""",
    "definition": """SELECT concat('c', o_custkey) AS path, concat('sym:', o_orderkey) AS symbol, CAST(datediff('1995', o_orderdate) AS INT) AS start_line, CAST(o_orderkey % 80 AS INT) AS start_character,
        CAST(datediff('1995', o_orderdate) + 20 + o_orderkey % 200 AS INT) AS end_line, CAST(o_orderkey % 40 AS INT) AS end_character, o_orderkey AS pos FROM {orders}""",
    "reference": """SELECT site_id AS ref_id, concat('c', o_custkey) AS path, CAST(datediff('1995', l_shipdate) AS INT) AS line, CAST(l_quantity AS INT) AS character, concat('part:', l_partkey) AS symbol, site_id AS pos FROM {line}""",
    "occurrence": """SELECT concat('c', o_custkey) AS path, site_id AS pos, CASE WHEN l_linenumber = 7 THEN concat('local ', l_suppkey) ELSE concat('part:', l_partkey) END AS symbol, CAST(l_linenumber AS INT) AS line, CAST(l_quantity AS INT) AS character,
        CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INT) AS roles, CASE WHEN l_linestatus = 'F' THEN 'method' ELSE 'struct' END AS kind, CASE WHEN l_tax < 0.02 THEN NULL ELSE l_tax > 0.04 END AS is_name FROM {line}""",
    "change_event": """SELECT concat('root', user_id % 5) AS root, event_id, ts, concat('/p', user_id) AS path, CASE WHEN event_type = 'signup' THEN 'created' WHEN event_type = 'error' THEN 'deleted' ELSE 'changed' END AS kind FROM {events}""",
    "watch_event": """SELECT root, event_id, ts, path, CASE WHEN event_id % 97 = 0 THEN 'lock' WHEN event_id % 97 = 9 THEN 'unlock' WHEN event_id % 211 = 5 THEN 'rescan' ELSE kind END AS kind,
        CASE WHEN event_id % 422 = 5 THEN concat('/p', event_id % 13, '=created,/q', event_id % 17, '=deleted') END AS found FROM {change_event}""",
    "snapshot_old": """SELECT concat('d', c_nationkey, '/f', c_custkey) AS path, c_custkey % 9 = 0 AS is_dir, CAST(c_custkey % 100 AS BIGINT) AS len, CAST(c_nationkey AS BIGINT) AS modified FROM {customer} WHERE c_custkey % 5 <> 0""",
    "snapshot_new": """SELECT concat('d', c_nationkey, '/f', c_custkey) AS path, c_custkey % 18 = 0 AS is_dir, CAST(CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 50 ELSE c_custkey % 100 END AS BIGINT) AS len, CAST(c_nationkey AS BIGINT) AS modified FROM {customer} WHERE c_custkey % 7 <> 0""",
    "log_message": """SELECT conv_id * 100 + turn AS pos, conv_id * 1000 + turn * 37 AS ts_ms, CASE WHEN role = 'user' THEN 'client' ELSE 'server' END AS sender, CASE WHEN role = 'user' THEN 'request' WHEN role = 'assistant' THEN 'response' ELSE 'notification' END AS kind,
        concat('textDocument/m', conv_id % 7) AS method, concat(CAST(conv_id AS VARCHAR(20)), ':', CAST(turn - turn % 2 AS VARCHAR(20))) AS id, CAST(length(text) AS BIGINT) AS bytes, text AS body FROM {conversations}""",
    "session_message": """SELECT conv_id AS session, turn AS pos, CASE WHEN turn % 2 = 0 THEN 'client' ELSE 'server' END AS sender, CASE WHEN turn IN (0, 1, 3) THEN 'request' WHEN turn = 2 OR turn = 5 THEN 'response' ELSE 'notification' END AS kind,
          CASE turn WHEN 0 THEN CASE WHEN conv_id % 5 = 4 THEN 'shutdown' ELSE 'initialize' END WHEN 1 THEN 'workspace/configuration' WHEN 3 THEN CASE WHEN conv_id % 3 = 0 THEN 'client/registerCapability' ELSE 'workspace/configuration' END WHEN 4 THEN CASE WHEN conv_id % 7 = 0 THEN 'textDocument/didChange' ELSE 'textDocument/didOpen' END WHEN 6 THEN CASE WHEN conv_id % 2 = 0 THEN 'textDocument/didChange' ELSE 'textDocument/didOpen' END ELSE '' END AS method,
          CASE WHEN turn IN (1, 2) THEN '1' WHEN turn = 3 THEN '2' ELSE concat('x', turn) END AS id,
          translate(CASE WHEN turn = 0 THEN concat('<"params":<"capabilities":<"workspace":<', CASE conv_id % 3 WHEN 0 THEN '' WHEN 1 THEN '"didChangeWatchedFiles":<"dynamicRegistration":true>' ELSE '"didChangeWatchedFiles":null' END, '>>', CASE conv_id % 4 WHEN 0 THEN '' WHEN 1 THEN ',"rootUri":null' ELSE concat(',"rootUri":"file:///p', conv_id, '"') END, '>>')
            WHEN turn = 2 THEN CASE WHEN conv_id % 2 = 0 THEN '<"error":<"code":-32601,"message":"no">>' ELSE '<"result":null>' END WHEN turn IN (4, 6) THEN concat('<"params":<"textDocument":<"uri":"file:///d', CASE WHEN conv_id % 11 = 0 THEN turn ELSE 0 END, '">>>') ELSE '<>' END, '<>', concat(chr(123), chr(125))) AS msg FROM {conversations}""",
    "mark": """SELECT conv_id * 1000 AS ts_ms, concat('step', conv_id) AS step FROM (SELECT DISTINCT conv_id FROM {conversations} WHERE conv_id % 10 = 3) AS t""",
    "tag": """SELECT concat('part:', p_partkey) AS item, 'brand' AS key, p_brand AS value FROM {part} UNION ALL SELECT concat('part:', p_partkey), 'type', p_type FROM {part}
        UNION ALL SELECT concat('part:', p_partkey), 'size', CAST(p_size AS VARCHAR(20)) FROM {part} UNION ALL SELECT concat('part:', l_partkey), 'flag', l_returnflag FROM {lineitem} WHERE l_quantity > 45 GROUP BY l_partkey, l_returnflag""",
    "tag_line": """SELECT p_partkey * 3 + p_partkey % 2 AS line_no, CASE p_partkey % 29 WHEN 0 THEN 'dir:src' WHEN 1 THEN concat('sym:', p_name) WHEN 2 THEN concat('file:./src/', p_partkey) WHEN 3 THEN concat('file:src//', p_partkey)
          WHEN 4 THEN concat('file:/src/', p_partkey) WHEN 5 THEN concat('file:src/../', p_partkey) WHEN 6 THEN 'file:' ELSE concat('file:src/', lpad(CAST(p_partkey - CASE WHEN p_partkey % 31 = 0 THEN 40 ELSE 0 END AS VARCHAR(20)), 9, '0'), '.rs') END AS item,
        CASE WHEN p_size = 5 THEN '' ELSE concat('area=', p_brand, '|', CASE p_size WHEN 7 THEN 'kind=function' WHEN 8 THEN 'a<b' WHEN 9 THEN 'owner=core' WHEN 11 THEN 'area=x/y' ELSE concat('type=', p_type) END, CASE p_size WHEN 9 THEN '|owner=core' WHEN 13 THEN '|kind=a|kind=b' ELSE '' END) END AS tags FROM {part}""",
    "symbol_string": """SELECT CASE WHEN p_partkey % 6 = 0 THEN concat('local ', p_partkey) WHEN p_partkey % 6 = 1 THEN concat('rust-analyzer cargo my-shop 1.0 ', replace(lower(p_brand), '#', '_'), '/Item#') WHEN p_partkey % 6 = 2 THEN concat('rust-analyzer cargo my-shop 1.0 ', replace(lower(p_brand), '#', '_'), '/Item#run().')
        WHEN p_partkey % 6 = 3 THEN concat('scip-go gomod shop . `a/', replace(lower(p_brand), '#', '_'), '`/Item#') WHEN p_partkey % 6 = 4 THEN concat('scip-go gomod shop . `a/', replace(lower(p_brand), '#', '_'), '`/item().') ELSE concat('rust-analyzer cargo my-shop 1.0 ', replace(lower(p_brand), '#', '_'), '/Item.') END AS symbol, p_partkey AS n FROM {part}""",
    "node": """SELECT concat('c', o_custkey) AS file, o_orderkey AS node_id, CAST(datediff('1995', o_orderdate) * 10 AS BIGINT) AS start, CAST(datediff('1995', o_orderdate) * 10 + 200 + o_orderkey % 2000 AS BIGINT) AS end_at,
        CASE WHEN o_orderpriority LIKE '1%' THEN 'function_item' WHEN o_orderpriority LIKE '2%' THEN 'if_expression' WHEN o_orderpriority LIKE '3%' THEN 'while_expression' WHEN o_orderpriority LIKE '4%' THEN 'call_expression' ELSE 'block' END AS kind FROM {orders}""",
    "linked_node": """SELECT file, node_id, start, end_at, kind, lag(node_id) OVER (PARTITION BY file ORDER BY start, node_id) AS parent_id, CASE node_id % 3 WHEN 0 THEN 'body' WHEN 1 THEN 'condition' END AS field FROM {node}""",
    "code_line": """SELECT concat('c', o_custkey, '.rs') AS path, o_orderkey, seq, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, seq) - 1 AS INT) AS no, flag, partkey FROM
        (SELECT o_custkey, o_orderkey, CAST(0 AS BIGINT) AS seq, 'def' AS flag, CAST(NULL AS BIGINT) AS partkey FROM {orders}
         UNION ALL SELECT o_custkey, l_orderkey, site_id % 1000, l_returnflag, CAST(l_partkey AS BIGINT) FROM {line}) AS t""",
    "control_kind": """SELECT 'if_expression' AS kind, 'conditional' AS control UNION ALL SELECT 'while_expression', 'loop'""",
    "source_line": """SELECT doc_id, lang, text FROM {documents} WHERE text IS NOT NULL""",
    "url": """SELECT page_id, url FROM {pages}""",
}

#: How each engine says days since the start of 1995.
_DAYS = {"spark": r"datediff(\1, DATE'1995-01-01')", "duckdb": r"datediff('day', DATE '1995-01-01', CAST(\1 AS DATE))"}


def _sql(name: str, engine: str) -> str:
    return re.sub(r"datediff\('1995', (\w+)\)", _DAYS[engine], RELATIONS[name])


def needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z_]+)\}", text)))


def relation(spark, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None, text: str | None = None) -> DataFrame:
    """A table or relation; those in `given` are taken as they are, and so is `text` for the relation's own."""
    if given and name in given:
        return given[name]
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = text or _sql(name, "spark")
    frames = {x: relation(spark, sf_dir, x, given) for x in needs(text)}
    if name == "line":  # joined and numbered by order, in tasks of bounded rows
        frames["lineitem"] = dealer(frames["lineitem"])(frames["lineitem"], "l_orderkey")
    text = re.sub(r"\{([a-z_]+)\}\.\*", lambda m: m[1] + "_.*", text)  # a table's own columns
    for x in frames:
        text = text.replace("{" + x + "}", "{" + x + "} AS " + x + "_", 1) if f"{x}_.*" in text else text
    return spark.sql(text, **frames)


#: The columns that order the lines of an order.
LINE_ORDER = re.search(r"ORDER BY (.*?)\)", RELATIONS["line"])[1]


def lines_upto(r, last: str):
    """`r` for queries that read no column of lines after `last` in their order. Lines that tie up to it are equal in all
    that such a query reads, so it gives the same rows whichever of them comes first: they are numbered without the columns
    after it, which are then not shuffled."""
    columns = LINE_ORDER.split(", ")
    line = r("line", text=RELATIONS["line"].replace(LINE_ORDER, ", ".join(columns[: columns.index(last) + 1])))
    return lambda name: r(name, {"line": line})


def lines_once(r):
    """`r` for queries that read both sites and targets: the numbered lines under them are joined and numbered once and
    written, not once for each reader."""
    line = checkpointed(lines_upto(r, "l_linestatus")("line").drop("l_suppkey", "l_extendedprice", "l_discount", "l_shipdate"))
    return lambda name: r(name, {"line": line})


def oracle(query: str) -> str:
    """The query for DuckDB, with the relations that it names by {name} as common table expressions."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in order:
            return
        for x in needs(RELATIONS[name]):
            visit(x)
        order.append(name)

    for x in needs(query):
        visit(x)
    plain = lambda s: re.sub(r"\{([a-z_]+)\}", r"\1", s)
    ctes = [f"{x} AS ({plain(_sql(x, 'duckdb'))})" for x in order]
    body = plain(query).strip()
    if not ctes:
        return body
    if body[:4].upper() == "WITH":
        recursive = body[4:].lstrip().upper().startswith("RECURSIVE")
        return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(ctes) + ", " + body[4:].lstrip()[9 * recursive :]
    return "WITH " + ", ".join(ctes) + " " + body
