"""Registered queries over tag files."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import graph_views
from graphloom.plans.inputs import oracle

#: The files that exist: those of most entries that have a normalised path.
FILES = "SELECT DISTINCT item FROM {tag_line} WHERE line_no % 19 <> 0 AND starts_with(item, 'file:src/0')"
CHECKED = f"""WITH l AS (SELECT line_no, item, list_filter(string_split(tags, '|'), lambda t: t <> '') AS tags FROM {{tag_line}}), e AS (SELECT line_no, unnest(tags) AS tag, tags FROM l)
  SELECT line_no, 'bad-kind' AS violation FROM l WHERE NOT starts_with(item, 'file:') AND NOT starts_with(item, 'sym:') UNION ALL SELECT line_no, 'symbol-item' FROM l WHERE starts_with(item, 'sym:')
  UNION ALL SELECT line_no, 'bad-path' FROM l WHERE starts_with(item, 'file:') AND NOT regexp_full_match(item, 'file:src/[0-9]+[.]rs') UNION ALL SELECT line_no, 'no-tags' FROM l WHERE len(tags) = 0
  UNION ALL SELECT DISTINCT line_no, concat('bad-tag ', tag) FROM e WHERE contains(tag, '<') UNION ALL SELECT DISTINCT line_no, concat('bad-value ', tag) FROM e WHERE contains(tag, '/')
  UNION ALL SELECT DISTINCT line_no, 'reserved-key kind' FROM e WHERE starts_with(tag, 'kind=') UNION ALL SELECT line_no, concat('duplicate-tag ', tag) FROM e GROUP BY line_no, tag HAVING count(*) > 1
  UNION ALL SELECT line_no, 'tags-unsorted' FROM l WHERE tags <> list_sort(tags) UNION ALL SELECT line_no, concat('duplicate-item of line ', f) FROM (SELECT line_no, min(line_no) OVER (PARTITION BY item) AS f FROM l) WHERE line_no > f
  UNION ALL SELECT line_no, 'unsorted' FROM (SELECT line_no, item, lag(item) OVER (ORDER BY line_no) AS p FROM l) WHERE item < p UNION ALL SELECT line_no, 'orphan' FROM l WHERE item NOT IN ({FILES})"""


def lines(r):
    return r("tag_line").withColumn("tags", F.filter(F.split("tags", "[|]"), lambda t: t != ""))


def files(r):
    return r("tag_line").where("line_no % 19 <> 0 AND startswith(item, 'file:src/0')").select("item").distinct()


ENTRIES = {
    "check_tags": (lambda r: graph_views.check_tags(lines(r), files(r)), CHECKED),
}


def oracle_sql() -> dict:
    return {name: oracle(sql) for name, (_, sql) in ENTRIES.items() if sql}
