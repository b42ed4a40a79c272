"""Names, ids, URIs, positions and source text as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Characters that Windows forbids in names; each is kept as U+F000 plus its code.
FORBIDDEN = '<>:"|?*'
PRIVATE = "".join(chr(0xF000 + ord(c)) for c in FORBIDDEN)


def normalize_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def to_windows_name(name: Column) -> Column:
    return F.translate(name, FORBIDDEN, PRIVATE)


def from_windows_name(name: Column) -> Column:
    return F.translate(name, PRIVATE, FORBIDDEN)


def encode_item_id(space: Column, name: Column) -> Column:
    """`file:` or `sym:` and the name, quoted when it has white space or a quote."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.concat(space, F.lit(":"), F.when(name.rlike(r'[\s"]'), quoted).otherwise(name))


def decode_item_id(item: Column) -> Column:
    """struct(space, name, error). Errors: unknown-space, empty-name, unclosed-quote, bad-escape."""
    space = F.regexp_extract(item, "^(file|sym):", 1)
    rest = F.regexp_replace(item, "^(file|sym):", "")
    quoted = rest.startswith('"')
    body = F.regexp_extract(rest, r'^"((?:[^"\\]|\\.)*)"$', 1)
    closed = rest.rlike(r'^"((?:[^"\\]|\\.)*)"$')
    error = F.when(space == "", "unknown-space").when(rest.isin("", '""'), "empty-name").when(quoted & ~closed, "unclosed-quote").when(quoted & body.rlike(r'(^|[^\\])(\\\\)*\\[^"\\]'), "bad-escape")
    name = F.when(quoted, F.regexp_replace(body, r'\\(["\\])', "$1")).otherwise(rest)
    return F.when(error.isNotNull(), F.struct(F.lit(None).cast("string").alias("space"), F.lit(None).cast("string").alias("name"), error.alias("error"))).otherwise(F.struct(space.alias("space"), name.alias("name"), F.lit(None).cast("string").alias("error")))


def relative_uri(uri: Column, root: Column) -> Column:
    """The decoded path below root, or null for what isn't a file under it. A plus sign is a plus sign."""
    path = F.try_url_decode(F.replace(F.regexp_replace(uri, "^file://", ""), F.lit("+"), F.lit("%2B")))
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(uri.startswith("file://") & F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path)))


def unquote_literal(text: Column) -> Column:
    """A literal's text without prefix letters, as many hashes at both ends as it begins with, and one pair of quotes."""
    bare = F.regexp_replace(text, "^[A-Za-z]+", "")
    n = F.length(F.regexp_extract(bare, "^(#*)", 1))
    rest = F.when(2 * n <= F.length(bare), F.substring(bare, n + 1, F.length(bare) - 2 * n)).otherwise(bare)
    out = rest
    for quote in ("`", "'", '"', "'''", '"""'):
        pattern = f"(?s)^{quote}(.*){quote}$"
        out = F.when(rest.rlike(pattern), F.regexp_extract(rest, pattern, 1)).otherwise(out)
    return out


def source_tag(tool: Column) -> Column:
    name, version = F.get(F.split(tool, " "), F.lit(0)), F.get(F.split(tool, " "), F.lit(1))
    return F.when(F.coalesce(name, F.lit("")) == "", "scip@unknown").when(version.isNull(), F.concat(F.lit("scip@"), name)).otherwise(F.concat(F.lit("scip@"), name, F.lit("-"), version))


def declares_function(lang: Column, source: Column) -> Column:
    """Whether the source has a language's key word for functions, not inside a longer word, and a name after it."""
    before = r"(?<![\p{IsAlphabetic}\p{N}_])"
    return (
        F.when(lang == "rust", source.rlike(before + r"fn\s+[\p{IsAlphabetic}_]"))
        .when(lang == "go", source.rlike(before + r"func\s+[\p{IsAlphabetic}_(]"))
        .when(lang == "python", source.rlike(before + r"def\s+[\p{IsAlphabetic}_]"))
        .when(lang == "typescript", source.rlike(r"=>|(?<![\p{IsAlphabetic}\p{N}_$])(function|class)(?![\p{IsAlphabetic}\p{N}_$])"))
        .otherwise(F.lit(False))
    )


def log_failures(lines: DataFrame) -> DataFrame:
    """line, skipped_file of log lines that tell of a failure or of a file that was skipped."""
    line = F.trim("line")
    errors = F.trim(F.regexp_extract(line, r"^Analysis errors: ([^,]*)", 1))
    bad = line.startswith("Error:") | line.endswith("aborting") | (line.startswith("Analysis errors: ") & (errors != "0"))
    skipped = F.nullif(F.regexp_extract(line, r"skipping file '(.*?)' because", 1), F.lit(""))
    return lines.where(bad | skipped.isNotNull()).select(line.alias("line"), skipped.alias("skipped_file"))


def is_name(text: Column, start: Column, end: Column) -> Column:
    """Whether the characters [start, end) have a letter, digit or underscore; null where they aren't in the text."""
    inside = (start >= 0) & (end >= start) & (end <= F.length(text))
    return F.when(inside, F.substring(text, start + 1, end - start).rlike(r"[\p{IsAlphabetic}\p{N}_]"))


def is_called(after: Column) -> Column:
    """Whether the text after a name begins, past white space and one balanced `::<…>`, with `(`. The flat case is a
    regular expression; nested brackets are counted."""
    rest = F.regexp_replace(F.ltrim(F.translate(after, "\n\r\t", "   ")), "^:: +", "::")
    generic = rest.startswith("::<")
    step = lambda a, c: F.struct(
        F.when(a["done"] > 0, a["depth"]).otherwise(a["depth"] + F.when(c == "<", 1).when(c == ">", -1).otherwise(0)).alias("depth"),
        (a["at"] + 1).alias("at"),
        F.when((a["done"] == 0) & (c == ">") & (a["depth"] == 1), a["at"] + 1).otherwise(a["done"]).alias("done"),
    )
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("done"))
    close = F.aggregate(F.split(F.substring(rest, F.lit(3), F.length(rest)), ""), zero, step, lambda a: a["done"])
    tail = F.ltrim(F.substring(rest, F.lit(3) + close, F.length(rest)))
    return F.when(rest.startswith("("), True).when(generic, F.when(close > 0, tail.startswith("(")).otherwise(False)).otherwise(False)


def line_offsets(files: DataFrame) -> DataFrame:
    """path, text → path, line (from 0), text, offset: the byte at which each line starts."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(F.octet_length("text") + 1).over(before), F.lit(0)))


def byte_offset(lines: DataFrame, positions: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """positions: path, line, column in bytes (utf-8) or UTF-16 units. Adds `byte`; null past the end of the line, or
    inside a character."""
    joined = positions.join(lines, ["path", "line"], "left")
    return joined.withColumn("byte", F.col("offset") + byte_in_line(F.col("text"), F.col("column"), encoding)).drop("text", "offset")


def byte_in_line(text: Column, column: Column, encoding: str = "utf-8") -> Column:
    """The bytes before a column of a line, null past its end. In UTF-16 the units before the column are decoded by
    themselves; it is null where the last of them opens a pair, inside a character."""
    if encoding == "utf-8":
        return F.when((column >= 0) & (column <= F.octet_length(text)), column)
    units = F.encode(text, "UTF-16BE")
    opens = F.hex(F.substring(units, 2 * column - 1, F.lit(1))).between("D8", "DB") & (column > 0)
    inside = (column >= 0) & (2 * column <= F.octet_length(units)) & ~opens
    return F.when(inside, F.octet_length(F.decode(F.when(inside, F.substring(units, F.lit(1), 2 * column)), "UTF-16BE")))


def json_path(value: Column, path: str) -> Column:
    """The text at a dotted path of a JSON text; null where it is absent."""
    return F.try_variant_get(F.try_parse_json(value), "$." + path, "string")


def json_presence(value: Column, path: str) -> Column:
    """`absent`, `null` or `present`: what a dotted path of a JSON text holds; absent, too, where the text isn't JSON."""
    found = F.try_variant_get(F.try_parse_json(value), "$." + path, "variant")
    return F.when(found.isNull(), "absent").when(F.is_variant_null(found), "null").otherwise("present")


def describe_response(body: Column) -> Column:
    """`error <code> <message>`, `result (N bytes)` over 120 bytes, or `result <json>`."""
    v = F.try_parse_json(body)
    error, result = F.try_variant_get(v, "$.error", "variant"), F.try_variant_get(v, "$.result", "variant")
    text = F.to_json(result)
    told = F.when(F.octet_length(text) > 120, F.concat(F.lit("result ("), F.octet_length(text).cast("string"), F.lit(" bytes)"))).otherwise(F.concat(F.lit("result "), F.coalesce(text, F.lit("null"))))
    return F.when(error.isNotNull(), F.concat_ws(" ", F.lit("error"), F.try_variant_get(v, "$.error.code", "string"), F.try_variant_get(v, "$.error.message", "string"))).otherwise(told)
