"""Written intermediate tables.

Some results feed several consumers (a match table that yields document
frequencies, corpus totals and scores).  They are written once to the shared
folder named by ``spark.checkpoint.dir`` and read back: the source is scanned
once, the lineage ends there, and a lost executor costs a re-read instead of a
recomputation.
"""
from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

SETTING = "spark.checkpoint.dir"
#: rows that may pass through the driver instead of the shared folder
PINNED_ROWS = 20_000


def staging_root(spark: SparkSession) -> str:
    """Shared folder from the session; a temporary one only for local sessions."""
    configured = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="plansift-")
    spark.conf.set(SETTING, folder)
    return folder


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return the written table."""
    path = f"{staging_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pinned(df: DataFrame, label: str, limit: int = PINNED_ROWS) -> tuple[DataFrame, pa.Table | None]:
    """``df`` evaluated once, and its rows where they are few.

    A result of at most ``limit`` rows becomes a local relation of one partition: its size is
    known, and grouping or ranking it needs no exchange.  A larger one is staged.
    """
    rows = df.limit(limit + 1).toArrow()
    if rows.num_rows <= limit:
        return df.sparkSession.createDataFrame(rows, df.schema).coalesce(1), rows
    return stage(df, label), None


def small(df: DataFrame, label: str) -> DataFrame:
    """``df`` evaluated once, with a broadcast hint where its rows were counted and are few."""
    table, rows = pinned(df, label)
    return table if rows is None else F.broadcast(table)
