"""Registered queries: each Spark plan with, where SQL can say it, its DuckDB text."""
from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from plansift.plans.registered import media, parts, search, text, upkeep

_MODULES = (text, search, parts, media, upkeep)


def _wide(fn):
    """Whole numbers as BIGINT, the width SQL gives to ranks and counts."""
    @wraps(fn)
    def run(spark, sf_dir):
        df = fn(spark, sf_dir)
        return df.select(*[F.col(name).cast("bigint").alias(name) if kind == "int" else F.col(name)
                           for name, kind in df.dtypes])
    return run


def queries():
    return {name: _wide(fn) for module in _MODULES for name, fn in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
