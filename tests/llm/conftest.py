import os

import pyarrow as pa
import pytest

SF = "/root/testdata/sf0.001"
CLASHES = ("fp", "key", "n_words", "rank_", "body", "tokens", "found", "root", "id", "length")


def pytest_collection_modifyitems(items):
    if not os.path.isdir(SF):
        for item in items:
            item.add_marker(pytest.mark.skip(reason="no test data"))


@pytest.fixture(scope="session")
def texts(spark):
    """(doc_id, text) of the sample documents."""
    return [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]


@pytest.fixture(scope="session")
def documents(spark):
    """Table of documents from (doc_id, text, lang, source), with columns whose names operators use inside."""
    def make(rows):
        columns = list(zip(*rows)) if rows else [()] * 4
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
        data = {n: pa.array(c, k) for n, c, k in zip(("doc_id", "text", "lang", "source"), columns, kinds)}
        data["n_chars"] = pa.array([None if r[1] is None else len(r[1]) for r in rows], pa.int64())
        data |= {c: pa.array([f"{c}{i}" for i in range(len(rows))], pa.string()) for c in CLASHES}
        return spark.createDataFrame(pa.table(data))
    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Null and empty texts, null ids and levels, repeated rows, one very long text."""
    prose = " ".join(f"word{i} of a plain sentence." for i in range(40))
    return [(1, None, "en", "src1"), (2, "", None, None), (3, " \t\n ", "en", "src1"), (None, prose, "de", "src2"),
            (None, prose, "de", "src2"), (5, prose, "en", "src3"), (5, prose, "en", "src3"), (6, prose.upper(), "en", "src3"),
            (7, "Ünïcode 你好 " * 30, "fr", "src4"), (8, "one more long text with number 12 here. " * 30000, "en", "src0")]
