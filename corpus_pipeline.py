"""The training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

Quality rejects documents, exact and near deduplication keep one document of each group, decontamination
drops documents that hold too much of the benchmark, and packing cuts what is left into sequences. Every
stage but the last returns the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession

from larder.llm import decontaminate, dedup, packing, quality, simhash
from larder.llm.base import table
from larder.session import apply_defaults, stage


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    apply_defaults(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    apply_defaults(spark)
    return dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: three-word shingles, at most three bits apart."""
    apply_defaults(spark)
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without too much of the benchmark."""
    apply_defaults(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    apply_defaults(spark)
    return packing.piece_rows(docs)


STAGES = [("quality", good), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminated),
          ("packing", packed)]

# The classifier has no SQL; tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
