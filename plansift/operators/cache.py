"""Answer cache: keyed lookup and bounded store."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plansift.functions import text as T
from plansift.operators.relational import first_inserted


def lookup(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """``asked(question, signature, ...)`` with the cached ``answer`` or null."""
    keyed = asked.withColumn("key", T.cache_key(F.col("question"), F.col("signature")))
    return keyed.join(cache.select("key", "answer"), "key", "left")


def store(cache: DataFrame, fresh: DataFrame, size: int = 200) -> DataFrame:
    """Cache ``(key, answer, first_inserted_at)`` after new answers.

    A key stored again takes the new answer and keeps its place; beyond ``size`` the
    earliest inserted keys go.  A size of 0 keeps nothing.
    """
    rows = cache.withColumn("round", F.lit(0)).unionByName(fresh.withColumn("round", F.lit(1)))
    merged = rows.groupBy("key").agg(
        F.max_by("answer", F.struct("round", "first_inserted_at")).alias("answer"),
        F.min("first_inserted_at").alias("first_inserted_at"))
    kept = first_inserted(merged.select("key", "first_inserted_at"), "key", "first_inserted_at", size).select("key")
    return merged.join(kept, "key", "left_semi")
