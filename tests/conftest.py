import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

from plansift.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """Small local table from a schema string and rows."""
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64(),
             "strings": pa.list_(pa.string()), "doubles": pa.list_(pa.float64())}

    def make(schema, rows):
        fields = [f.split(" ") for f in schema.split(", ")]
        columns = {name: pa.array([r[i] for r in rows], kinds[kind]) for i, (name, kind) in enumerate(fields)}
        return spark.createDataFrame(pa.table(columns))
    return make


@pytest.fixture(scope="session")
def evaluate(table):
    """Value of a column function of one string, for several strings."""
    from pyspark.sql import functions as F

    def run(fn, values):
        df = table("i int, x string", list(enumerate(values)))
        rows = df.select("i", fn(F.col("x")).alias("y")).collect()
        return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]
    return run
