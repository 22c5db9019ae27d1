import duckdb
import numpy as np
import pyarrow as pa

from plansift.llm import embeddings as E


def slow_links(ids, vectors, threshold=0.9):
    """{row: (n_links, component_id)} from all pairs."""
    n = len(ids)
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) for v in vectors]
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                near[i, j] = a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold
    root = np.arange(n)
    while True:
        new = np.minimum(root, np.array([root[row].min() if row.any() else n for row in near]))
        if (new == root).all():
            break
        root = new
    least = {r: min(ids[i] for i in range(n) if root[i] == r) for r in set(root.tolist())}
    return sorted((ids[i], int(near[i].sum()), least[root[i]], ids[i] == least[root[i]]) for i in range(n))


def test_query_equals_duckdb(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS FROM '/root/testdata/sf0.01/embeddings.parquet'")
    assert sorted(map(tuple, E.op3_embeddings(spark, "/root/testdata/sf0.01").collect())) == sorted(con.execute(E.ORACLE).fetchall())


def table(spark, ids, vectors):
    return spark.createDataFrame(pa.table({
        "vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float64())),
        "node": pa.array(["x"] * len(ids)), "key": pa.array([None] * len(ids), pa.string())})).repartition(3)


def test_groups_copies_and_large_components(spark):
    """Dense groups that fill every list, copies, chains; lists and blocks small enough to overflow."""
    rng = np.random.default_rng(1)
    loose = rng.standard_normal((300, 16))
    dense = rng.standard_normal(16) + 0.15 * rng.standard_normal((90, 16))
    chain = [np.cos(a) * np.eye(16)[0] + np.sin(a) * np.eye(16)[1] for a in np.arange(0, 1.5, 0.3)]
    vectors = [v.tolist() for v in (*loose, *dense, *chain)] + [loose[0].tolist()] * 20 + [(3 * loose[1]).tolist()]
    ids = rng.permutation(len(vectors)).tolist()
    how = E.Descent(lists=6, trees=4, leaf_rows=40, block_rows=32)
    got = sorted(map(tuple, E.near_vectors(table(spark, ids, vectors), how=how).collect()))
    assert got == slow_links(ids, vectors)


def test_edges(spark):
    vectors = [None, [], [0.0, 0.0], [1.0, None], [1.0, float("nan")], [float("inf"), 1.0], [1.0, 0.0], [1e300, 0.0], [-1.0, 0.0],
               [1.0, 0.0, 0.0], [1e-300, 1e-302]]
    ids = list(range(10, 21))
    got = sorted(map(tuple, E.near_vectors(table(spark, ids, vectors)).collect()))
    assert [r[1] for r in got] == [0] * 6 + [2, 2, 0, 0, 2] and got[10][2] == 16 and not got[10][3]
    assert all(r[2] == r[0] and r[3] for r in got[:7])
    assert E.near_vectors(table(spark, [], [])).count() == 0
    same = E.near_vectors(table(spark, [None, 4, 4], [[1.0, 2.0]] * 3)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in same) == [
        ("4", 2, 4, True), ("4", 2, 4, True), ("None", 2, 4, False)]


def test_audit_finds_what_is_missing(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((50, 8))
    vectors = [v.tolist() for v in (*base, *(base + 0.01))]
    nodes = E.prepare(table(spark, list(range(100)), vectors), "vec_id", "embedding").selectExpr("vec_id AS node", "unit", "1L AS n")
    half = spark.range(100).selectExpr("id AS node", "CASE WHEN id % 2 = 0 THEN 1L ELSE 0L END AS links")
    assert 0.3 < E.audit(nodes, half, 0.9, 100) < 0.7


def test_links_between_full_lists(spark):
    """Two dense groups, 0.99 inside and 0.92 across: every list is full of its own group."""
    rng = np.random.default_rng(3)
    turn = np.arccos(0.925)
    centers = [np.eye(24)[0], np.cos(turn) * np.eye(24)[0] + np.sin(turn) * np.eye(24)[1]]
    vectors = []
    for c in centers:
        for _ in range(60):
            v = rng.standard_normal(24) * ([0] * 2 + [1] * 22)
            vectors.append((c + 0.07 * v / np.linalg.norm(v)).tolist())
    ids = rng.permutation(len(vectors)).tolist()
    how = E.Descent(lists=6, trees=4, leaf_rows=16, repeats=0)
    got = sorted(map(tuple, E.near_vectors(table(spark, ids, vectors), how=how).collect()))
    assert got == slow_links(ids, vectors) and len({r[2] for r in got}) == 1


def test_all_pairs_where_the_audit_stays_low(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((60, 8))
    vectors = [v.tolist() for v in (*base, *(base + 0.05 * rng.standard_normal(base.shape)))]
    how = E.Descent(lists=1, trees=1, leaf_rows=16, rounds=0, recall=1.1, repeats=0)
    got = sorted(map(tuple, E.near_vectors(table(spark, list(range(120)), vectors), how=how).collect()))
    assert got == slow_links(list(range(120)), vectors)
