"""The corpus pipeline: stages over ``documents``, each reading what the one before it kept.

Toxic documents go, of near copies one document stays, documents with benchmark passages go, the rest is drawn to the
target mixture, and what is drawn gets its shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locusflow.llm._common import materialize, table
from locusflow.llm.decontaminate import drop_contaminated
from locusflow.llm.mixing import mixed
from locusflow.llm.sharding import shard_assignments
from locusflow.llm.simhash import drop_near_duplicates
from locusflow.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose sets of five-word shingles have a similarity of 0.8 or more, counted exactly, are near duplicates."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs, table(spark, sf_dir, "labels"))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each drawn document goes; ``write_shards`` writes texts by it."""
    return shard_assignments(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

# models and near-duplicate groups cannot be expressed in SQL; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
