"""The pipeline over ``documents``: stages that each read what their predecessor wrote.

Documents of poor quality go first, then exact copies, near copies, and documents with benchmark passages; what is
left is mixed to target weights. A stage returns the columns of its input; the last adds ``size``, ``taken`` and
``repeats``. Null ids, null texts, repeated rows and empty tables follow the operators' own rules: rows are told apart
by their place in the table, not by their id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import decontaminate, exact_dedup, mixing, quality, simhash
from loomline.sources.shared import made, settled


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: SQL expresses neither the classifier nor the knapsack; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from ``documents``."""
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"), since)
    return STAGES[-1][1](spark, docs, sf_dir)
