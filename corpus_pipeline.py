"""From raw documents to packed sequences: each stage reads what the one before has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm import catalog, decontaminate, near_dups, substring_dedup, toxicity
from tallyward.llm.common import read
from tallyward.session import checkpoint_dir

# Rows that a batch for Python may have: a batch lies in an executor's memory several times, in Spark and in the worker.
BATCH_ROWS = 2_000

# The models have no SQL; tests compare the operators with plain versions.
ORACLE_SQL = None


def small_batches(spark: SparkSession) -> None:
    """The session's batches for Python get at most BATCH_ROWS rows; fewer, if it says so."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    small_batches(spark)
    return toxicity.clean_documents(docs, read(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, on shingles of five words."""
    small_batches(spark)
    return near_dups.one_of_each(docs, words=5, percent=80)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without passages that an earlier document has; n_chars follows the text."""
    return substring_dedup.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"), catalog.WINDOW)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in sequences of at most 1024 tokens."""
    return catalog.packed(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("minhash_near_dedup", without_near_duplicates),
    ("substring_dedup", without_repeated_passages),
    ("benchmark_decontamination", without_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each result is written to the shared folder and read again."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
