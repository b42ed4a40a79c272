"""File-change events and snapshots, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.folds import folded, state_of, table_of


def merge_events(events: DataFrame) -> DataFrame:
    """root, path, kind: each path's changes in order of ts and event_id, merged; those that cancel are left out. Changes
    are composed stretch by stretch (see folds), so no path's history is gathered."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = folded(events.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp"))), ["root", "path"], ms, ["_us", "event_id"], table_of(F.col("kind")))
    return rows.select("root", "path", state_of(F.col("table")).alias("kind")).where("kind <> 'none'")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, kind: created, deleted or changed. A directory that stays one is never changed."""
    a = old.select("path", F.struct("is_dir", "len", "modified").alias("a"))
    b = new.select("path", F.struct("is_dir", "len", "modified").alias("b"))
    other = (F.col("a.is_dir") != F.col("b.is_dir")) | (~F.col("b.is_dir") & ((F.col("a.len") != F.col("b.len")) | ~F.col("a.modified").eqNullSafe(F.col("b.modified"))))
    kind = F.when(F.col("a").isNull(), "created").when(F.col("b").isNull(), "deleted").when(other, "changed")
    return a.join(b, "path", "full").select("path", kind.alias("kind")).where("kind IS NOT NULL")


def ancestors(path: Column) -> Column:
    """The directories above a path, outermost first."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.expr("cast(array() as array<string>)"))


def subtree(snapshot: DataFrame, dirs: DataFrame) -> DataFrame:
    """dir, path: each directory of `dirs` with itself and all below it. Paths meet directories on their ancestors, an
    equality join instead of a prefix comparison of all pairs."""
    own = snapshot.select("path", F.explode(F.array_append(ancestors(F.col("path")), F.col("path"))).alias("dir"))
    return own.join(dirs.select("dir").distinct(), "dir").select("dir", "path")


def component_order(path: Column) -> Column:
    """Sort key that orders paths by their components."""
    return F.split(path, "/")


def cascade_delete(dirs: DataFrame, snapshot: DataFrame) -> DataFrame:
    """path, kind: deletes for all that lies below deleted directories."""
    return subtree(snapshot, dirs).where("dir <> path").select("path", F.lit("deleted").alias("kind")).distinct()


def classify_path(path: Column, excluded_prefixes: list[str], excluded_components: list[str], lock: str = ".git/index.lock") -> Column:
    """index-lock, excluded or watched."""
    prefix = F.lit(False)
    for p in excluded_prefixes:
        prefix = prefix | (path == p) | path.startswith(p.rstrip("/") + "/")
    component = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(c) for c in excluded_components])) if excluded_components else F.lit(False)
    return F.when(path == lock, "index-lock").when(prefix | component, "excluded").otherwise("watched")


def classify_change(observed: DataFrame, snapshot: DataFrame) -> DataFrame:
    """observed: path, is_dir, len, modified (is_dir null: not there) against the known entry → path, kind rows:
    created, changed, deleted; a type flip deletes the subtree and creates the path."""
    a = snapshot.select("path", F.struct("is_dir", "len", "modified").alias("a"))
    rows = observed.select("path", F.when(F.col("is_dir").isNotNull(), F.struct("is_dir", "len", "modified")).alias("b")).join(a, "path", "left")
    flip = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a.is_dir") != F.col("b.is_dir"))
    differs = ~F.col("b.is_dir") & ((F.col("a.len") != F.col("b.len")) | ~F.col("a.modified").eqNullSafe(F.col("b.modified")))
    kinds = F.when(flip, F.array(F.lit("deleted"), F.lit("created"))).when(F.col("a").isNull() & F.col("b").isNotNull(), F.array(F.lit("created"))).when(F.col("a").isNotNull() & F.col("b").isNull(), F.array(F.lit("deleted"))).when(F.col("a").isNotNull() & differs, F.array(F.lit("changed")))
    own = rows.select("path", F.explode(kinds).alias("kind"), (F.coalesce(F.col("a.is_dir"), F.lit(False))).alias("was_dir"))
    below = cascade_delete(own.where("kind = 'deleted' AND was_dir").select(F.col("path").alias("dir")), snapshot)
    return own.select("path", "kind").union(below)


def advance_baseline(baseline: DataFrame, batch: DataFrame, observed: DataFrame) -> DataFrame:
    """The baseline snapshot after a flushed batch (path, kind) with the entries observed for its paths."""
    kept = baseline.join(batch.select("path"), "path", "left_anti")
    new = observed.join(batch.where("kind <> 'deleted'").select("path").distinct(), "path", "left_semi")
    return kept.unionByName(new.select(*baseline.columns))
