"""A corpus pipeline: quality rules, near duplicates, repeated passages, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ebbmark.llm import line_dedup, ngram_join, packing, pii, quality
from ebbmark.llm.common import small_batches, table
from ebbmark.session import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    small_batches(spark)
    return quality.kept_documents(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8 or more."""
    small_batches(spark)
    return ngram_join.one_of_each(docs, words=5, similar=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines and sentences that an earlier document holds are cut; ``n_chars`` follows the text."""
    small_batches(spark)
    return _measured(line_dedup.without_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text."""
    return _measured(pii.redacted(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of every part of every document."""
    small_batches(spark)
    return packing.pack(docs)


def _measured(docs: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the fitted field, the packing and others; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
