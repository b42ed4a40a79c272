"""Helpers that the training-data operators share: the cluster's shared folder, staged tables, `let`."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.frames import shared_folder

#: White space that separates words: space and TAB to CR, and nothing else.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
#: Rows of an Arrow batch while a table is staged and in the pipeline: a batch of whole texts stays at some megabytes.
ARROW_ROWS, ARROW_CONF = 2_000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of an Arrow batch where rows hold whole texts, of which some may be very long.
ARROW_BYTES, ARROW_BYTES_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> str:
    """Holds the session's Arrow batches to ARROW_ROWS rows from here on; gives the setting before."""
    before = spark.conf.get(ARROW_CONF)
    spark.conf.set(ARROW_CONF, str(min(int(before), ARROW_ROWS) if int(before) > 0 else ARROW_ROWS))
    return before


def light_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to ARROW_BYTES from here on, besides their rows: a few very long texts don't
    make a batch of hundreds of megabytes, in the JVM and once more in Python."""
    spark.conf.set(ARROW_BYTES_CONF, str(ARROW_BYTES))


def give_back() -> None:
    """In a task: memory that this reused worker has freed goes back to the system, as far as its allocators can tell."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: lineage ends here, and a lost executor
    costs no recomputation of what came before."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    before = small_batches(spark)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_CONF, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstaged(*frames: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more: all that was made of them is staged itself."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, also where `body` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_words(text: Column, run: str = SPACE_RUN) -> Column:
    """Words between runs of separators; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), run), "")


def bounded(df: DataFrame, limit: int) -> bool:
    """Whether `df` has at most `limit` rows; never counts far beyond it."""
    return df.limit(limit + 1).count() <= limit


def once(df: DataFrame, key: str, *others: str) -> DataFrame:
    """`df` with one row for each (key, *others). Only the rows whose key repeats are shuffled for it; `df` is read
    more than once."""
    repeated = staged(df.groupBy(key).count().where("count > 1").select(F.col(key).alias("again")), "repeated")
    if repeated.isEmpty():
        return df
    met = df[key].eqNullSafe(repeated["again"])
    return df.join(repeated, met, "left_anti").unionByName(df.join(repeated, met, "left_semi").dropDuplicates([key, *others]))
