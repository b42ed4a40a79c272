"""Report documents: one JSON text, assembled from sorted parts that are written in order.

A document is a table of lines with sort keys. Sorting by them spreads the lines over files whose order is that of the
text, so no task holds a whole document; joined in the order of their names, the files are the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["section", "a", "b", "c"]
THRESHOLD_PERCENT = 50


def _line(section: int, text: Column, a=None, b=None, c=None) -> list[Column]:
    key = lambda x, n: (F.lit(None).cast("string") if x is None else x).alias(n)
    return [F.lit(section).alias("section"), key(a, "a"), key(b, "b"), key(c, "c"), text.alias("line")]


def _fixed(spark, rows: list[tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame([(n, None, None, None, text) for n, text in rows], "section int, a string, b string, c string, line string")


def _listed(rows: DataFrame, section: int, columns: list[str], key: list[str]) -> DataFrame:
    """A line for each row as a JSON object; all but the first, by `key` with nulls first, begin with a comma."""
    keys = [F.coalesce(F.concat(F.lit("1"), F.col(k)), F.lit("0")) for k in key] or [F.lit("0")]
    rows = rows.select(*[k.alias(n) for k, n in zip(keys, KEYS[1:], strict=False)], F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("object"))
    names = KEYS[1 : 1 + len(keys)]
    least = rows.agg(F.min(F.struct(*names)).alias("k")).first()["k"] or [None] * len(names)  # one row
    is_first = F.array(*names) == F.array(*[F.lit(x) for x in least])
    return rows.select(*_line(section, F.concat(F.when(is_first, "").otherwise(","), "object"), *map(F.col, names)))


def _rate(rows: DataFrame) -> DataFrame:
    return rows.withColumn("unresolved_rate", F.round(F.try_divide(F.col("unresolved").cast("double"), F.col("call_sites")), 6))


def _quoted(text: Column) -> Column:
    """A text as JSON, by way of a list of it."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def edge_lines(counts: DataFrame, section: int) -> DataFrame:
    """Lines of counts (provider, path, edge_count) as an object of objects, without the outer braces."""
    providers = counts.groupBy("provider").agg(F.min("path").alias("first_path"))
    least = providers.agg(F.min("provider")).first()[0]  # one row
    comma = lambda is_first: F.when(is_first, "").otherwise(",")
    opens = providers.select(*_line(section, F.concat(comma(F.col("provider") == F.lit(least)), _quoted(F.col("provider")), F.lit(":{")), F.col("provider"), F.lit("0")))
    closes = providers.select(*_line(section, F.lit("}"), F.col("provider"), F.lit("2")))
    text = F.concat(comma(F.col("path") == F.col("first_path")), _quoted(F.col("path")), F.lit(":"), F.col("edge_count").cast("string"))
    paths = counts.join(providers, "provider").select(*_line(section, text, F.col("provider"), F.lit("1"), F.col("path")))
    return opens.unionByName(closes).unionByName(paths)


def report_lines(generation: int, modules: DataFrame, languages: DataFrame, total: DataFrame, previous: int | None, drops: DataFrame, baseline: DataFrame | None, counts: DataFrame) -> DataFrame:
    """A report's lines with their keys. modules, languages and total have call_sites, resolved and unresolved; drops are
    (provider, path, previous, current), baseline the differences (provider, path, expected, found) if there was one, and
    counts (provider, path, edge_count)."""
    spark, figures = modules.sparkSession, ["call_sites", "resolved", "unresolved", "unresolved_rate"]
    fixed = [(0, f'{{"generation":{generation},'), (1, '"modules":['), (3, '],"languages":['), (5, '],"total":'), (7, f',"regression":{{"previous":{"null" if previous is None else previous},"threshold_percent":{THRESHOLD_PERCENT},"drops":['), (9, ']},"baseline":' + ("null" if baseline is None else '{"differences":[')), (11, ("" if baseline is None else "]}") + ',"edge_counts":{'), (13, "}}")]
    out = _fixed(spark, fixed)
    out = out.unionByName(_listed(_rate(modules), 2, ["language", "package", "module", *figures], ["language", "package", "module"])).unionByName(_listed(_rate(languages), 4, ["language", *figures], ["language"]))
    out = out.unionByName(_listed(_rate(total), 6, figures, [])).unionByName(_listed(drops, 8, ["provider", "path", "previous", "current"], ["provider", "path"]))
    if baseline is not None:
        out = out.unionByName(_listed(baseline, 10, ["provider", "path", "expected", "found"], ["provider", "path"]))
    return out.unionByName(edge_lines(counts, 12))


def baseline_lines(counts: DataFrame) -> DataFrame:
    """The lines of a baseline document of edge counts."""
    return _fixed(counts.sparkSession, [(0, "{"), (2, "}")]).unionByName(edge_lines(counts, 1))


def write_document(lines: DataFrame, folder: str) -> None:
    """Writes a document's lines in order; the files of the folder, in the order of their names, are the text."""
    lines.orderBy(*KEYS).select(F.col("line").alias("value")).write.text(folder)
