"""Symbol strings: parsing, formatting, names and classes.

A symbol is `scheme manager name version descriptors` or `local N`. Parsing runs once per distinct symbol in an Arrow
UDF; all that follows works on the parsed struct with Spark functions.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARSED = "struct<local:string, scheme:string, manager:string, package:string, version:string, descriptors:array<struct<name:string, suffix:string, disambiguator:string>>, error:string>"

# Descriptor endings of the symbol grammar.
SUFFIXES = {"/": "namespace", "#": "type", ".": "term", ":": "meta", "!": "macro"}
NAME = re.compile(r"[A-Za-z0-9_+\-$]+")
FIELD, METHOD = re.compile(r"((?:[^ ]|  )*) "), re.compile(r"\(([A-Za-z0-9_+\-$]*)\)\.")
#: Symbols without doubled spaces, quoted names or parameters, and their descriptors: nearly all.
PLAIN = re.compile(r"(?!local )([^ ]+) ([^ ]+) ([^ ]+) ([^ ]+) ((?:[A-Za-z0-9_+\-$]+(?:[/#.:!]|\([A-Za-z0-9_+\-$]*\)\.))+)")
PART = re.compile(r"([A-Za-z0-9_+\-$]+)(?:([/#.:!])|\(([A-Za-z0-9_+\-$]*)\)\.)")
FIELDS, PARTS = ("local", "scheme", "manager", "package", "version"), ("name", "suffix", "disambiguator")


class BadSymbol(ValueError):
    pass


def _identifier(s: str, at: int) -> tuple[str, int]:
    if s[at : at + 1] == "`":
        out, i = [], at + 1
        while True:
            j = s.find("`", i)
            if j < 0:
                raise BadSymbol(f"unclosed ` at byte {len(s[:at].encode())}")
            out.append(s[i:j])
            if s[j : j + 2] != "``":
                return "".join(out), j + 1
            out.append("`")
            i = j + 2
    m = NAME.match(s, at)
    if not m:
        raise BadSymbol(f"no name at byte {len(s[:at].encode())}")
    return m[0], m.end()


def _descriptors(s: str, at: int) -> list[dict]:
    out = []
    while at < len(s):
        if s[at] in "([":
            close, suffix = (")", "parameter") if s[at] == "(" else ("]", "type_parameter")
            name, at = _identifier(s, at + 1)
            if s[at : at + 1] != close:
                raise BadSymbol(f"no {close} at byte {len(s[:at].encode())}")
            out.append({"name": name, "suffix": suffix, "disambiguator": ""})
            at += 1
            continue
        name, at = _identifier(s, at)
        if s[at : at + 1] == "(":
            m = METHOD.match(s, at)
            if not m:
                raise BadSymbol(f"bad method at byte {len(s[:at].encode())}")
            out.append({"name": name, "suffix": "method", "disambiguator": m[1]})
            at = m.end()
        elif s[at : at + 1] in SUFFIXES and at < len(s):
            out.append({"name": name, "suffix": SUFFIXES[s[at]], "disambiguator": ""})
            at += 1
        else:
            raise BadSymbol(f"no suffix at byte {len(s[:at].encode())}")
    return out


def parse_symbol(s: str | None) -> dict | None:
    """The parsed struct; its `error` names the byte at which the symbol breaks the grammar."""
    blank = {"local": None, "scheme": None, "manager": None, "package": None, "version": None, "descriptors": [], "error": None}
    if s is None:
        return None
    if s.startswith("local "):
        return blank | ({"local": s[6:]} if NAME.fullmatch(s[6:]) else {"error": "bad local at byte 6"})
    parts, at = [], 0
    for _ in range(4):  # fields end at a single space; a doubled one is part of the field
        m = FIELD.match(s, at)
        if not m:
            return blank | {"error": f"missing field at byte {len(s[:at].encode())}"}
        parts.append(m[1].replace("  ", " "))
        at = m.end()
    if not parts[0]:
        return blank | {"error": "empty scheme at byte 0"}
    scheme, manager, package, version = (parts[0], *("" if p == "." else p for p in parts[1:]))
    try:
        found = _descriptors(s, at)
        if not found:
            raise BadSymbol(f"no descriptor at byte {len(s[:at].encode())}")
    except BadSymbol as e:
        return blank | {"error": str(e)}
    return blank | {"scheme": scheme, "manager": manager, "package": package, "version": version, "descriptors": found}


def _parsed(s: str) -> tuple:
    """The values of FIELDS, the error, and a tuple of PARTS for each descriptor. Plain symbols are split by one pattern."""
    if m := PLAIN.fullmatch(s):
        scheme, *rest, tail = m.groups()
        return (None, scheme, *["" if x == "." else x for x in rest], None, [(name, SUFFIXES.get(mark, "method"), number) for name, mark, number in PART.findall(tail)])
    row = parse_symbol(s)
    return (*[row[c] for c in FIELDS], row["error"], [tuple(d[c] for c in PARTS) for d in row["descriptors"]])


def parse_distinct(df: DataFrame, column: str = "symbol", into: str = "parsed") -> DataFrame:
    """A column of symbols, none of them null or repeated, and their parsed structs."""

    def run(batches):
        import pyarrow as pa

        text = lambda values: pa.array(values, pa.string())
        for batch in batches:
            if not batch.num_rows:
                continue
            *fields, error, parts = zip(*map(_parsed, batch[column].to_pylist()), strict=True)
            ends = pa.array([0, *itertools.accumulate(map(len, parts))], pa.int32())
            each = list(zip(*itertools.chain.from_iterable(parts), strict=True)) or [()] * len(PARTS)
            found = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([text(x) for x in each], PARTS))
            made = [*map(text, fields), found, text(error)]
            yield pa.RecordBatch.from_arrays([batch[column], pa.StructArray.from_arrays(made, [*FIELDS, "descriptors", "error"])], [column, into])

    return df.select(column).mapInArrow(run, f"`{column}` string, `{into}` {PARSED}")


def parse_symbols(df: DataFrame, column: str = "symbol", into: str = "parsed") -> DataFrame:
    """Adds the parsed struct of a column of symbols. Each distinct symbol is parsed once."""
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    return df.join(parse_distinct(distinct, column, into), column, "left")


def malformed(parsed: DataFrame, column: str = "symbol", into: str = "parsed") -> DataFrame:
    """The rejects: symbols with their error."""
    return parsed.where(F.col(f"{into}.error").isNotNull()).select(column, F.col(f"{into}.error").alias("error"))


def format_symbol(p: Column) -> Column:
    """The inverse of parsing. A name is escaped only when it needs it."""
    field = lambda c: F.when(F.coalesce(c, F.lit("")) == "", ".").otherwise(F.replace(c, F.lit(" "), F.lit("  ")))
    name = lambda n: F.when(n.rlike(r"^[A-Za-z0-9_+\-$]+$"), n).otherwise(F.concat(F.lit("`"), F.replace(n, F.lit("`"), F.lit("``")), F.lit("`")))

    def one(d: Column) -> Column:
        n, s = name(d["name"]), d["suffix"]
        out = F.when(s == "method", F.concat(n, F.lit("("), d["disambiguator"], F.lit(")."))).when(s == "parameter", F.concat(F.lit("("), n, F.lit(")"))).when(s == "type_parameter", F.concat(F.lit("["), n, F.lit("]")))
        for mark, suffix in SUFFIXES.items():
            out = out.when(s == suffix, F.concat(n, F.lit(mark)))
        return out

    glob = F.concat_ws(" ", F.replace(p["scheme"], F.lit(" "), F.lit("  ")), field(p["manager"]), field(p["package"]), field(p["version"]), F.array_join(F.transform(p["descriptors"], one), ""))
    return F.when(p["local"].isNotNull(), F.concat(F.lit("local "), p["local"])).otherwise(glob)


def _rust(p: Column) -> Column:
    return p["scheme"] == "rust-analyzer"


def last(p: Column) -> Column:
    return F.try_element_at(p["descriptors"], F.lit(-1))


def parent(p: Column) -> Column:
    return F.try_element_at(p["descriptors"], F.lit(-2))


def _impl_at(d: Column, i: Column) -> Column:
    """Whether descriptor i (0-based) opens an impl block: a type `impl` with a type parameter after it."""
    x, y = F.get(d, i), F.get(d, i + 1)
    return F.coalesce((x["suffix"] == "type") & (x["name"] == "impl") & (y["suffix"] == "type_parameter"), F.lit(False))


def in_impl(p: Column) -> Column:
    d = p["descriptors"]
    return F.exists(F.transform(d, lambda x, i: _impl_at(d, i)), lambda x: x)


def is_impl_block(p: Column) -> Column:
    """An impl block itself: nothing but type parameters after its `impl`."""
    d = p["descriptors"]
    outer = F.filter(F.transform(d, lambda x, i: F.when(x["suffix"] != "type_parameter", i)), lambda i: i.isNotNull())
    return F.coalesce(_rust(p) & _impl_at(d, F.try_element_at(outer, F.lit(-1))), F.lit(False))


def _dotted(p: Column, d: Column) -> Column:
    """Descriptor names joined by dots, under the crate's name for Rust; impl blocks and the crate root don't show."""
    plus = lambda x: F.when(F.coalesce(x, F.lit("")) == "", "").when(x.startswith("+"), x).otherwise(F.concat(F.lit("+"), x))
    hidden = lambda x, i: _rust(p) & (_impl_at(d, i) | ((i == 0) & (x["suffix"] == "namespace") & (x["name"] == "crate")))
    part = lambda x: F.replace(F.replace(F.concat(x["name"], plus(x["disambiguator"])), F.lit("::"), F.lit(".")), F.lit("/"), F.lit("."))
    names = F.transform(F.filter(d, lambda x, i: ~hidden(x, i)), part)
    return F.array_join(F.when(_rust(p) & (p["package"] != ""), F.array_prepend(names, F.replace(p["package"], F.lit("-"), F.lit("_")))).otherwise(names), ".")


def canonical_name(p: Column) -> Column:
    """Dotted name; null for locals, parameters, impl blocks, malformed symbols and names with control characters."""
    parameter = F.exists(p["descriptors"], lambda x: x["suffix"] == "parameter")
    name = F.when(p["local"].isNull() & p["error"].isNull() & ~parameter & ~is_impl_block(p), _dotted(p, p["descriptors"]))
    return F.when(~name.rlike(r"\p{Cc}"), name)


def has_control_character(p: Column) -> Column:
    return F.exists(p["descriptors"], lambda x: x["name"].rlike(r"\p{Cc}"))


def module_ancestors(p: Column) -> Column:
    """Names of the leading namespaces before the last descriptor, outermost first; the crate root is left out."""
    leads = F.aggregate(p["descriptors"], F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, d: F.struct((a["n"] + F.when(a["on"] & (d["suffix"] == "namespace"), 1).otherwise(0)).alias("n"), (a["on"] & (d["suffix"] == "namespace")).alias("on")), lambda a: a["n"])
    depth = F.least(leads, F.size(p["descriptors"]) - 1)
    first = F.when(_rust(p) & (F.get(p["descriptors"], F.lit(0))["name"] == "crate"), 2).otherwise(1)
    return F.when(depth >= first, F.transform(F.sequence(first, depth), lambda i: _dotted(p, F.slice(p["descriptors"], 1, i)))).otherwise(F.expr("cast(array() as array<string>)"))


def snake(kind: Column) -> Column:
    return F.lower(F.regexp_replace(kind, "(?<!^)([A-Z])", "_$1"))


def symbol_kind(p: Column, info_kind: Column) -> Column:
    """The indexer's kind in snake case, else one that the last descriptor and its parent tell."""
    suffix, above = last(p)["suffix"], parent(p)["suffix"]
    told = F.when(suffix.isNull(), "unknown").when(suffix == "method", F.when(above.isNull() | (above == "namespace"), "function").otherwise("method")).otherwise(suffix)
    return F.coalesce(snake(info_kind), told)


# Kinds that can be called, kinds of modules, and kinds of static values.
CALLABLE = ("abstract_method", "constructor", "function", "getter", "macro", "method", "method_alias", "method_specification", "protocol_method", "pure_virtual_method", "setter", "singleton_method", "static_method", "trait_method", "type_class_method")
MODULES = ("module", "namespace", "package", "file")
STATICS = ("static_variable", "static_field", "static_data_member", "static_property")


def is_callable(p: Column, kind: Column) -> Column:
    return F.when(kind.isNotNull(), snake(kind).isin(*CALLABLE)).otherwise(F.coalesce(last(p)["suffix"].isin("method", "macro"), F.lit(False)))


def is_module(p: Column, kind: Column) -> Column:
    return F.when(kind.isNotNull(), snake(kind).isin(*MODULES)).otherwise(F.coalesce(last(p)["suffix"] == "namespace", F.lit(False)))


def is_macro(p: Column, kind: Column) -> Column:
    return F.coalesce(snake(kind) == "macro", F.lit(False)) | F.coalesce(last(p)["suffix"] == "macro", F.lit(False))


def ref_kind(macro: Column, called: Column) -> Column:
    return F.when(macro, "macro").when(called, "call").otherwise("value")


def dispatch_class(p: Column) -> Column:
    """static, virtual or unknown: only the Rust indexer's shapes tell. A method directly under a type is a trait's."""
    suffix, above = last(p)["suffix"], parent(p)["suffix"]
    method = F.when(in_impl(p) | above.isNull() | (above == "namespace"), "static").when(above == "type", "virtual").otherwise("unknown")
    return F.when(~F.coalesce(_rust(p), F.lit(False)), "unknown").when(suffix == "macro", "static").when(suffix == "method", method).otherwise("unknown")


def namespace_class(p: Column, kind: Column) -> Column:
    """type, fn, const, static, field or other; the indexer's kind comes first."""
    k, suffix, above = snake(kind), last(p)["suffix"], parent(p)["suffix"]
    by_kind = F.when(k == "macro", "other").when(k.isin(*CALLABLE), "fn").when(k == "constant", "const").when(k.isin(*STATICS), "static").when(k == "field", "field")
    by_shape = F.when(suffix.isin("namespace", "type", "type_parameter"), "type").when(suffix == "method", "fn").when(suffix == "term", F.when(above == "type", "field").otherwise("const")).otherwise("other")
    return F.coalesce(by_kind, by_shape)
