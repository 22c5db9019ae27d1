import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plansift.sources import vector_index as V


def vectors_of(spark, matrix, name="page_id", parts=5):
    rows = pa.table({name: pa.array(range(len(matrix)), pa.int64()), "vec": pa.array([None if v is None else list(map(float, v)) for v in matrix], pa.list_(pa.float64()))})
    return spark.createDataFrame(rows).repartition(parts)


def clustered(n=3000, dim=16, groups=30, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim))
    v = centers[rng.integers(0, groups, n)] + 0.25 * rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1)[:, None]


def brute(m, q, k):
    sims = np.round(q @ m.T, V.DIGITS)
    return [[(int(i), s[i]) for i in np.lexsort((np.arange(len(m)), -s))[:k]] for s in sims]


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.qid, r["rank"])):
        out.setdefault(r.qid, []).append((r.page_id, r.cos))
    return out


@pytest.fixture(scope="module")
def data():
    m = clustered()
    m[2000:2050] = m[0]  # more copies of one vector than are asked for
    return m


@pytest.fixture(scope="module")
def index(spark, data, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors"))
    V.write_vectors(vectors_of(spark, data), path)
    return V.VectorIndex(spark, path)


def test_exact_search_equals_brute_force_and_skips_cells(spark, data, index):
    q = np.concatenate([data[::100], 3 * data[5:6], np.zeros((1, 16))])
    queries = vectors_of(spark, q, "qid")
    want = dict(enumerate(brute(data, q, 12)))
    got = lists(index.nearest(queries, 12))
    assert got.keys() == want.keys()
    for i in want:
        assert [p for p, _ in got[i]] == [p for p, _ in want[i]], i
        assert [c for _, c in got[i]] == pytest.approx([c for _, c in want[i]])
    assert 0 < index.opened < index.pairs / 2
    assert {i: [p for p, _ in r] for i, r in lists(V.nearest_rows(vectors_of(spark, data), queries, 12)).items()} == {
        i: [p for p, _ in r] for i, r in want.items()}


def test_probing_recalls_nine_of_ten(spark, data, index):
    q = data[::20]
    got = lists(index.nearest(vectors_of(spark, q, "qid"), 10, probes=5))
    want = brute(data, q, 10)
    recall = np.mean([len({p for p, _ in got[i]} & {p for p, _ in want[i]}) / 10 for i in range(len(q))])
    assert recall >= 0.9 and index.opened == 5 * len(q)
    assert all(got[i][0][1] == pytest.approx(1.0) for i in range(len(q)))


def test_every_vector_is_stored_within_its_bound(spark, data, index):
    rows = spark.read.parquet(f"{index.path}/vectors").toPandas()
    assert sorted(rows.page_id) == list(range(len(data)))
    dist = np.linalg.norm(np.stack(rows.vec) - index.centers[rows.cell.astype(int)], axis=1)
    radius = dict(zip(index.cells, index.radius))
    assert np.allclose(dist, rows.dist) and all(d <= radius[c] + 1e-12 for d, c in zip(dist, rows.cell.astype(int)))


def test_edges(spark, tmp_path):
    one = str(tmp_path / "one")
    V.write_vectors(vectors_of(spark, [[1.0, 0.0], None, [1.0, 0.0]]), one)
    index = V.VectorIndex(spark, one)
    assert lists(index.nearest(vectors_of(spark, [[2.0, 0.0], None], "qid"), 5)) == {0: [(0, 2.0), (2, 2.0)]}
    assert index.nearest(vectors_of(spark, [[1.0, 0.0]], "qid").limit(0), 5).count() == 0
    none = str(tmp_path / "none")
    V.write_vectors(vectors_of(spark, [None]), none)
    assert V.VectorIndex(spark, none).nearest(vectors_of(spark, [[1.0, 0.0]], "qid"), 5).count() == 0
    regions = vectors_of(spark, clustered(200)).withColumn("image_key", F.col("page_id") % 7).withColumnRenamed("page_id", "region_no")
    V.write_vectors(regions, str(tmp_path / "regions"), keys=("image_key", "region_no"), cells=4)
    hits = V.VectorIndex(spark, str(tmp_path / "regions")).nearest(vectors_of(spark, clustered(200)[:2], "qid"), 1).collect()
    assert sorted((r.qid, r.image_key, r.region_no) for r in hits) == [(0, 0, 0), (1, 1, 1)]
