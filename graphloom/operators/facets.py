"""Facet selection over tagged items (item, key, value), by predicate objects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Facet:
    """An atom (op with key and value), or and/or/not over others. `&`, `|` and `~` combine them."""

    op: str
    key: str = ""
    value: object = None
    parts: tuple[Facet, ...] = ()

    def __and__(self, other: Facet) -> Facet:
        return Facet("and", parts=(self, other))

    def __or__(self, other: Facet) -> Facet:
        return Facet("or", parts=(self, other))

    def __invert__(self) -> Facet:
        return Facet("not", parts=(self,))


def facet_eq(key: str, value: str) -> Facet:
    return Facet("eq", key, value)


def facet_ne(key: str, value: str) -> Facet:
    """The key has a value other than `value`."""
    return Facet("ne", key, value)


def facet_has(key: str) -> Facet:
    return Facet("has", key)


def facet_lt(key: str, value: float) -> Facet:
    return Facet("lt", key, value)


def facet_gt(key: str, value: float) -> Facet:
    return Facet("gt", key, value)


def facet_path(key: str, pattern: str) -> Facet:
    """An anchored pattern in which `.` is any one character."""
    return Facet("path", key, pattern)


def _holds(f: Facet) -> Column:
    own, v = F.col("key") == f.key, F.col("value")
    test = {
        "eq": lambda: v == F.lit(f.value), "ne": lambda: v != F.lit(f.value), "has": lambda: v.isNotNull(),
        "lt": lambda: v.try_cast("double") < F.lit(f.value), "gt": lambda: v.try_cast("double") > F.lit(f.value),
        "path": lambda: v.rlike("^" + "".join("." if c == "." else "\\" + c if not c.isalnum() else c for c in str(f.value)) + "$"),
    }[f.op]()
    return F.coalesce(own & test, F.lit(False))


def _atoms(f: Facet) -> list[Facet]:
    return [a for p in f.parts for a in _atoms(p)] if f.parts else [f]


def _told(f: Facet, atoms: list[Facet]) -> Column:
    """Whether a predicate holds for an item with a column a0, a1, ... for each atom."""
    if not f.parts:
        return F.col(f"a{atoms.index(f)}")
    parts = [_told(p, atoms) for p in f.parts]
    if f.op == "not":
        return ~parts[0]
    return parts[0] & parts[1] if f.op == "and" else parts[0] | parts[1]


def _per_item(tags: DataFrame, atoms: list[Facet]) -> DataFrame:
    return tags.groupBy("item").agg(*[F.bool_or(_holds(a)).alias(f"a{i}") for i, a in enumerate(atoms)])


def select_items(tags: DataFrame, predicate: Facet) -> DataFrame:
    """The items for which the predicate holds. All atoms are told in one pass over the tags; a key with several values
    holds when any of them does; `not` is taken over all items."""
    atoms = list(dict.fromkeys(_atoms(predicate)))
    return _per_item(tags, atoms).where(_told(predicate, atoms)).select("item")


def facet_counts(tags: DataFrame) -> DataFrame:
    """key, items, values: distinct items and distinct values of each facet."""
    return tags.groupBy("key").agg(F.countDistinct("item").alias("items"), F.countDistinct("value").alias("values"))


def notify(batch: DataFrame, consumers: list[tuple[str, Facet]]) -> DataFrame:
    """consumer, item: the items of a batch of facets (item, key, value) that each consumer's predicate selects. The atoms
    of all predicates are told in one pass, and an item is written once for each consumer that gets it."""
    if not consumers:
        return batch.limit(0).select(F.lit("").alias("consumer"), "item")
    atoms = list(dict.fromkeys(a for _, p in consumers for a in _atoms(p)))
    gets = F.array_compact(F.array(*[F.when(_told(p, atoms), F.lit(name)) for name, p in consumers]))
    return _per_item(batch, atoms).select(F.explode(gets).alias("consumer"), "item")
