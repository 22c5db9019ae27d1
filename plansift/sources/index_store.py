"""Stored catalogue tables and imported key maps; the full-text index is in ``text_index``."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_tables(tables: Mapping[str, DataFrame], path: str) -> None:
    """Write catalogue tables, each as one Parquet folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def read_key_map(spark: SparkSession, path: str) -> DataFrame:
    """``key, value`` of a JSON object file; a broken file is an empty map."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string,string>")
    return text.select(F.explode(F.coalesce(entries, F.create_map().cast("map<string,string>"))))

