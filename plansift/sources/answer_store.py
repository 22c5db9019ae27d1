"""Stored answers: a keyed table in versions, of which the last one announced counts.

    <path>/answers/version=N/   key, answer, first_inserted_at
    <path>/current/             version, one row for every version that is complete

A merge writes the next version whole and announces it by one small file, so readers see the
old table or the new one.  A merge that fails leaves the old one; its rest is written over by the next.
One writer at a time is assumed.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from plansift.operators import cache
from plansift.staging import stage

COLUMNS = "key string, answer string, first_inserted_at long"
SIZE = 200


def _version(spark: SparkSession, path: str) -> int:
    try:
        return spark.read.schema("version long").parquet(f"{path}/current").agg(F.max("version")).first()[0] or 0
    except AnalysisException:  # nothing has been stored yet
        return 0


def read(spark: SparkSession, path: str) -> DataFrame:
    """``key, answer, first_inserted_at`` of the current version."""
    version = _version(spark, path)
    if not version:
        return spark.createDataFrame([], COLUMNS)
    return spark.read.schema(COLUMNS).parquet(f"{path}/answers/version={version}")


def merge(spark: SparkSession, path: str, fresh: DataFrame, size: int = SIZE) -> None:
    """Add ``fresh`` answers and evict the earliest inserted beyond ``size``, as one new version."""
    version = _version(spark, path) + 1
    table = cache.store(read(spark, path), fresh.select("key", "answer", "first_inserted_at"), size)
    table.write.mode("overwrite").parquet(f"{path}/answers/version={version}")
    spark.range(1).select(F.lit(version).cast("long").alias("version")).coalesce(1).write.mode("append").parquet(f"{path}/current")


def answered_before(spark: SparkSession, path: str, answered: DataFrame, size: int = SIZE, now: int | None = None) -> DataFrame:
    """``answered`` with stored answers in place of its own, and ``from_cache``.

    ``answered`` has ``question, signature, answer``; rows without a signature rest on no page and
    are neither looked up nor stored.  Answers not stored before are added at ``now`` (seconds); one question asked
    twice is stored once.
    """
    columns = [c for c in answered.columns if c != "answer"]
    rows = stage(cache.lookup(answered.withColumnRenamed("answer", "own"), read(spark, path)).withColumn(
        "from_cache", F.col("answer").isNotNull() & F.col("signature").isNotNull()), "looked-up")
    at = F.lit(now).cast("long") if now is not None else F.unix_timestamp()
    fresh = rows.filter(~F.col("from_cache") & F.col("signature").isNotNull() & F.col("own").isNotNull())
    merge(spark, path, fresh.groupBy("key").agg(F.min("own").alias("answer"), at.alias("first_inserted_at")), size)
    return rows.select(*columns, F.when(F.col("from_cache"), F.col("answer")).otherwise(F.col("own")).alias("answer"), "from_cache")
