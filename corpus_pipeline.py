"""A training corpus from raw documents: one operator after the other, each stage written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rosterlink.llm import language, minmax, mixing, packing, pii
from rosterlink.llm.text import documents, prepared
from rosterlink.session import scratch_dir


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts without a letter go."""
    prepared(spark)
    return language.recognised(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with shingle sets of similarity 0.8 or more."""
    prepared(spark)
    return minmax.without_near_duplicates(docs, similarity=(80, 100))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced in the texts."""
    prepared(spark)
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    prepared(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    prepared(spark)
    return packing.pack(docs)


STAGES = [("language", identify), ("near-dedup", deduplicate), ("pii", redact), ("mixing", mix), ("packing", pack)]

# The packing and the language models can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is Parquet in the shared folder before the next begins."""
    docs = documents(prepared(spark), sf_dir)
    folder = f"{scratch_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
