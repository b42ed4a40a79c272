"""Corpus pipeline over `documents`: language ID, n-gram Jaccard join, substring dedup, benchmark decontamination, packing.

Each stage works on all that its predecessor kept and is written and reread as the next one's input. All stages but the
last return the columns of `documents`; packing returns the pieces of the packed sequences with their ids.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.llm import decontamination, jaccard_join, language_id, packing, substring_dedup
from graphloom.llm.shared import light_batches, once, small_batches, staged

#: Packing and the learned language model are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def identify_language(spark, docs, sf_dir):
    """Documents whose language is told; those without a letter, and those far from every centroid, go."""
    small_batches(spark)
    light_batches(spark)
    return language_id.identify(docs, language_id.fit(docs)).where("NOT rejected").select(*docs.columns)


def one_of_each_group(spark, docs, sf_dir):
    """One document of each group of near copies stays, and one of rows that repeat a doc_id (or null) with its text."""
    small_batches(spark)
    kept = jaccard_join.keep_one(docs)
    return once(staged(kept, "kept-rows"), "doc_id", "text") if not docs.groupBy("doc_id").count().where("count > 1").isEmpty() else kept


def drop_repeats(spark, docs, sf_dir):
    """Repeated spans are cut from the texts; documents of which nothing is left go."""
    small_batches(spark)
    found = substring_dedup.remove_repeats(docs)
    changed = F.col("n_removed") > 0
    text = {"text": F.when(changed, F.col("kept")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars"))}
    return found.where("n_removed = 0 OR n_removed < n_words").select(*[text[c].alias(c) if c in text else F.col(c) for c in docs.columns])


def decontaminate(spark, docs, sf_dir):
    """Documents that hold a window of the benchmark go."""
    small_batches(spark)
    return decontamination.remove_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark, docs, sf_dir):
    small_batches(spark)
    light_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", drop_repeats),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
