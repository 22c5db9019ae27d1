"""Documents to packed training sequences: rules, near duplicates, personal data, mixture, packing.

``ORACLE_SQL`` is None: fingerprints, learned patterns and token ids are not
expressible in SQL; tests compare the run with a brute-force version.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plansift.llm import base, mixing, packing, pii, quality_rules, simhash
from plansift.staging import stage

ORACLE_SQL = None


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failed lines go, then documents that lose too much or fail the base rule."""
    base.bound_batches(spark)
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    base.bound_batches(spark)
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    base.bound_batches(spark)
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows by target weights; a document taken in two epochs comes twice."""
    return mixing.mix(docs, mixing.default_levels(), mixing.WEIGHTS).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in sequences of at most 4096 tokens."""
    base.bound_batches(spark)
    return packing.pack_documents(docs)


STAGES = [("quality rules", rules), ("near duplicates", near_duplicates), ("personal data", personal_data),
          ("mixture", mixture), ("packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
