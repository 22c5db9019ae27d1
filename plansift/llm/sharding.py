"""Sharding by jump consistent hashing: the key and the number of shards decide, no ring table is kept."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.llm.base import fresh, number_within, table

#: Step of the generator that the keys seed (64-bit linear congruential).
MULTIPLIER = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned key: it jumps ahead to ever higher shards and stays on the last one below ``shards``."""
    keys = keys.astype(np.uint64, copy=True)
    shard, ahead = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.float64)
    while (moving := np.flatnonzero(ahead < shards)).size:
        shard[moving] = ahead[moving]
        state = keys[moving] * np.uint64(MULTIPLIER) + np.uint64(1)
        keys[moving] = state
        ahead[moving] = np.floor((shard[moving] + 1) * (2.0 ** 31 / ((state >> np.uint64(33)).astype(np.float64) + 1)))
    return shard


def shard_documents(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard) for every row.

    Law ``key``: rows of one key share a shard; when a shard is appended, rows
    move only into it.  An integer key is used as it is, any other by its
    64-bit hash; a null key counts as 0.  Null texts have no bytes (size 8,
    CRC 0).  Slots number a shard's rows from 0 by key, repeated rows in any
    order; they come from range partitions, not from a task per shard.  Texts
    are read in one pass and are not shuffled.
    """
    kind = dict(docs.dtypes)[key]
    number = F.col(key) if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(key)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(number.cast("long"), F.lit(0)).alias("number"),
                       (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
                       F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"))
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def place(batches):
        for batch in batches:
            keys = batch.column(1).to_numpy().view(np.uint64)
            made = [pa.array(jump(keys, n).astype(np.int32)) for n in (shards, shards + 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "shard", "grown_shard"])

    placed = rows.mapInArrow(place, types + ", shard int, grown_shard int").withColumn("row", F.monotonically_increasing_id())
    slots = number_within(placed, ["shard"], ["doc_id", "row"], fresh("slot", placed.columns))
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))
