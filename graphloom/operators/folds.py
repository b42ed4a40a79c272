"""Ordered folds without gathering a key's history.

A step of a finite state machine is a table of states, and tables compose: the events of a stretch of time become one
table, stretches become tables of longer stretches, and only a bounded number of tables meets in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a path's merged change, as digits of two bits; a table holds the digit that follows each.
STATES = ("none", "created", "changed", "deleted")
#: Two changes of one path as one (fixed values): for each kind, what follows each state.
STEPS = {"created": ("created", "created", "created", "changed"), "changed": ("changed", "created", "changed", "changed"), "deleted": ("deleted", "none", "deleted", "deleted")}
#: Milliseconds of a stretch at each level, as powers of two: 17 minutes, 12 days, 35 years.
LEVELS = (20, 30, 40)


def table_of(kind: Column) -> Column:
    """A change's table."""
    out = None
    for name, follows in STEPS.items():
        code = sum(STATES.index(s) << 2 * i for i, s in enumerate(follows))
        out = F.when(kind == name, code) if out is None else out.when(kind == name, code)
    return out


def compose(first: Column, then: Column) -> Column:
    """The table of one stretch and the one after it."""
    at = lambda table, i: F.shiftright(table, 2 * i).bitwiseAND(3)
    reached = [at(first, i) for i in range(4)]
    follows = [sum((F.when(r == s, at(then, s)).otherwise(0) for s in range(1, 4)), F.when(r == 0, at(then, 0)).otherwise(0)) for r in reached]
    return sum((F.shiftleft(f, 2 * i) for i, f in enumerate(follows[1:], 1)), follows[0])


def state_of(table: Column) -> Column:
    """What a table makes of no change before it."""
    return F.element_at(F.array(*map(F.lit, STATES)), table.bitwiseAND(3) + 1)


def folded(events: DataFrame, keys: list[str], time: Column, order: list[str], table: Column) -> DataFrame:
    """keys and `table`: the composition of each key's tables in the order of time (milliseconds) and `order`."""
    same = sum(i << 2 * i for i in range(4))
    rows = events.select(*keys, time.alias("_time"), F.struct(time, *order).alias("_order"), table.alias("table"))
    for bits in (*LEVELS, None):
        by = [*keys] if bits is None else [*keys, F.shiftright("_time", bits).alias("_stretch")]
        ordered = F.array_sort(F.collect_list(F.struct("_order", "table")))
        rows = rows.groupBy(*by).agg(F.min("_time").alias("_time"), F.min("_order").alias("_order"), F.aggregate(ordered, F.lit(same), lambda a, x: compose(a, x["table"])).alias("table"))
    return rows.select(*keys, "table")


def decayed_counts(ops: DataFrame, half_life: float) -> DataFrame:
    """ops (actor, ts in seconds, op_id) with `before`, what an actor's count has decayed to when the op comes: each op adds
    1 and the count halves every `half_life`. Stretches of STRETCH half-lives are summed on their own; of a stretch
    before, what is left is one number, and of the fourth before nothing that a double can tell."""
    stretch = 64
    rows = ops.withColumn("_t", F.col("ts") / half_life).withColumn("_stretch", F.floor(F.col("_t") / stretch)).withColumn("_in", F.col("_t") - F.col("_stretch") * stretch)
    order = Window.partitionBy("actor", "_stretch").orderBy("ts", "op_id").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(F.pow(F.lit(2.0), "_in")).over(order), F.lit(0.0)) * F.pow(F.lit(2.0), -F.col("_in"))
    ends = rows.groupBy("actor", "_stretch").agg(F.sum(F.pow(F.lit(2.0), F.col("_in") - stretch)).alias("_left"))
    by_actor = Window.partitionBy("actor").orderBy("_stretch")
    carried = sum((F.coalesce(F.lag("_left", n).over(by_actor) * F.pow(F.lit(2.0), -(F.col("_stretch") - 1 - F.lag("_stretch", n).over(by_actor)) * stretch), F.lit(0.0)) for n in (2, 3)), F.coalesce(F.lag("_left", 1).over(by_actor) * F.pow(F.lit(2.0), -(F.col("_stretch") - 1 - F.lag("_stretch", 1).over(by_actor)) * stretch), F.lit(0.0)))
    carry = ends.select("actor", "_stretch", carried.alias("_carry"))
    return rows.withColumn("_own", own).join(carry, ["actor", "_stretch"]).withColumn("before", F.col("_own") + F.col("_carry") * F.pow(F.lit(2.0), -F.col("_in"))).drop("_t", "_stretch", "_in", "_own", "_carry")
