"""The corpus pipeline: each stage takes what its predecessor kept, and its decisions take effect."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import exact, langid, mixing, packing, simhash
from spanloom.shared import remove, shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go: null texts, texts without a letter, texts far from every centroid."""
    return langid.keep_known(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact.drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles of Jaccard similarity 0.8 or more, unlike op1's fingerprints."""
    return simhash.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its source's target takes it; the last one taken of a source may be cut."""
    return mixing.draw(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences, with their ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("language id", language_id),
    ("exact dedup", exact_dedup),
    ("near-dedup on word shingles", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the language model nor the curve; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents, each result written in the shared checkpoint folder and read again.

    A stage's result is removed when the next one's is written; the last, which the returned rows are made from, stays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}")
        docs = spark.read.parquet(f"{home}/{k}")
        if k:
            remove(spark, f"{home}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
