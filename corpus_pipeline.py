"""A training-data pipeline of five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm.base import shared_folder, ship, table
from lodestar.llm.classifier import keep_good
from lodestar.llm.decontaminate import without_benchmark
from lodestar.llm.jaccard import keep_one
from lodestar.llm.mixing import mixed
from lodestar.llm.queries import GOOD, quality_model
from lodestar.llm.rules import keep_by_rules


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier, learned from the given documents' labels, rejects."""
    ship(spark)
    return keep_good(docs, quality_model(docs, table(spark, sf_dir, "labels")), GOOD)


def within_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_by_rules(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    ship(spark)
    return keep_one(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold passages of the benchmark."""
    ship(spark)
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def in_proportion(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; ``copy`` numbers the copies."""
    return mixed(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("quality_rules", within_rules),
    ("near_duplicates", without_near_copies),
    ("decontamination", without_test_items),
    ("mixing", in_proportion),
]

#: The first stage learns a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
