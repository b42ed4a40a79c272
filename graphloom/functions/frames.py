"""Helpers over DataFrames."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset and all runs on this machine, a new local one;
    on a cluster its lack is an error, for executors don't see each other's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back, so that its lineage ends."""
    path = f"{shared_folder(df.sparkSession)}/frame-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task sorts or joins, about, where a table is dealt by its size.
TASK_ROWS = 250_000


def dealer(table: DataFrame):
    """A function that deals frames, of about as many rows as `table`, by keys to as many tasks as its rows ask for: of a
    larger table a task doesn't get more, whatever the session's number of partitions and however well its rows compress.
    Small tables stay as they are. `table` is counted, so it should be a plain or written one."""
    rows, least = table.count(), int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lambda df, *keys: df.repartition(max(least, -(-rows // TASK_ROWS)), *keys) if rows > 4 * TASK_ROWS else df
