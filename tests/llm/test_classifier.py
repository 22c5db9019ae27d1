import zlib

import numpy as np
import pytest

from plansift.llm import classifier as C


@pytest.fixture(scope="module")
def scored(spark):
    return C.op9_classifier(spark, "/root/testdata/sf0.1").toPandas()


def test_held_out_accuracy(spark, scored):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas().merge(scored, on="doc_id")
    test = labels[labels.held_out]
    assert len(test) > 500 and len(scored) == 10000
    pos, neg = test.score[test.quality == 1].to_numpy(), test.score[test.quality == 0].to_numpy()
    auc = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert auc > 0.97, auc
    assert ((test.predicted == 1) == (test.score >= 0.3)).all()
    assert (test.predicted == test.quality).mean() > 0.95 and test.predicted[test.quality == 1].mean() > 0.99


def test_folds(scored):
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(scored.doc_id[:500], scored.held_out[:500]))
    assert scored.score.between(0, 1).all()


def test_isotonic():
    x, y = C.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 2, 1, 3]), np.array([2.0, 2, 2, 3]))
    assert y.tolist() == [0, 0.75, 1] and x.tolist() == [0, 1.5, 3]


def test_normal_equations_equal_direct_ridge(spark):
    rng = np.random.default_rng(0)
    x = rng.random((200, len(C.FEATURES)))
    y = (x[:, 0] > 0.5).astype(int)
    df = spark.createDataFrame([(row.tolist(), int(v), i % 4 == 0) for i, (row, v) in enumerate(zip(x, y))],
                               "x array<double>, y int, calibrate boolean").repartition(5)
    how = C.Kernel(features=20)
    model = C.train(df, df, how)
    fit = np.arange(200) % 4 != 0
    z = model.expand(x[fit])
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + how.ridge * fit.sum() * np.eye(21), z.T @ y[fit]))
    assert np.allclose(model.mean, x.mean(0)) and (np.diff(model.curve[1]) > 0).all()


def test_edges(spark, documents, edge_rows):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (7, 1, 0), (8, None, 0), (None, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    docs = documents(edge_rows)
    rows = C.score_documents(docs, labels).collect()
    assert len(rows) == len(edge_rows) and all(0 <= r.score <= 1 for r in rows)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert {r.score for r in C.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert C.score_documents(documents([]), labels).count() == 0
