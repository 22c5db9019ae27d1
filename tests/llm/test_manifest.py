import hashlib
import zlib
from collections import defaultdict

import duckdb

from plansift.llm import manifest as M


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_leaf(row, more=0):
    values = (row[0], row[3], row[2], None if row[4] is None else row[4] + more, row[1])
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def slow_tree(nodes):
    """Root and, for each node, its (sibling, is left) by level."""
    proofs, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        higher, groups = [], []
        for i in range(0, len(nodes), 2):
            run = nodes[i:i + 2]
            for k in range(len(run)):
                for leaf in members[i + k]:
                    proofs[leaf].append((run[1 - k], k == 1) if len(run) == 2 else None)
            higher.append(sha("".join(run)))
            groups.append(sum(members[i:i + 2], []))
        nodes, members = higher, groups
    return nodes[0], proofs


def slow_manifest(rows):
    """Rows are (doc_id, text, lang, source, n_chars)."""
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    order = lambda r: (r[0] is not None, r[0] or 0, slow_leaf(r))
    made = {t: slow_tree([slow_leaf(r) for r in sorted(trees[t], key=order)]) for t in names}
    root, ends = slow_tree([made[t][0] for t in names])
    out = []
    for t, end in zip(names, ends):
        for r, proof in zip(sorted(trees[t], key=order), made[t][1]):
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = slow_leaf(r, 1) if hit else slow_leaf(r)
            for step in proof + end:
                folded = sha(folded if step is None else step[0] + folded if step[1] else folded + step[0])
            siblings = sha("".join(s[0] for s in proof + end if s))
            out.append((r[0], slow_leaf(r), made[t][0], root, siblings, folded, folded == root))
            assert (folded == root) == (not hit)
    return sorted(out, key=repr)


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_brute_force_and_sql(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    made = tuples(M.op13_manifest(spark, folder))
    assert made == slow_manifest([tuple(r) for r in docs.collect()])
    assert {r[-1] for r in made} == {True, False}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert sorted(con.execute(M.ORACLE).fetchall(), key=repr) == made


def test_all_heights_and_sizes(documents):
    """Sizes around powers of two, with superblocks of 2 and 4 rows, so that several levels are exchanged."""
    for size, height in ((1, 2), (2, 1), (5, 1), (8, 2), (9, 1), (33, 2)):
        rows = [(7 * i - 20, f"text {i}", "xy"[i % 5 == 0], "s") for i in range(size)]
        expected = slow_manifest([(*r, len(r[1])) for r in rows])
        made = tuples(M.prove(documents(rows), height=height).select("doc_id", "leaf", "subroot", "root", "proof_sha256"))
        assert made == sorted((r[:5] for r in expected), key=repr)


def test_proofs_stand_alone_and_tampering_shows(documents):
    from pyspark.sql import functions as F

    docs = documents([(i, f"text {i}", "en" if i % 3 else None, "s") for i in range(50)])
    rows = M.prove(docs, height=2).collect()
    assert len({r.root for r in rows}) == 1 and all(r.verified for r in rows)
    for r in rows:
        assert M.fold(r.leaf, r.proof.split(",")) == r.root
        assert M.fold(M.digest("other"), r.proof.split(",")) != r.root
    forged = F.when(F.col("doc_id") == 7, F.sha2(F.lit("x").cast("binary"), 256)).otherwise(M.leaf_digest([F.col(f) for f in M.FIELDS]))
    assert [r.doc_id for r in M.prove(docs, presented=forged, height=2).collect() if not r.verified] == [7]


def test_many_trees(documents):
    rows = [(i, "t", f"lang{i % 40:02d}", None) for i in range(90)]
    made = tuples(M.prove(documents(rows), height=2).select("doc_id", "leaf", "subroot", "root", "proof_sha256"))
    assert made == sorted((r[:5] for r in slow_manifest([(*r, 1) for r in rows])), key=repr)


def test_edges(documents, edge_rows):
    docs = documents([*edge_rows, (9, "empty name", "", "s"), (1 << 62, "large id", "en", "s"), (-5, "negative", "é", "s")])
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    made = tuples(M.prove(docs, height=1, with_proof=False).select("doc_id", "leaf", "subroot", "root", "proof_sha256"))
    assert made == sorted((r[:5] for r in slow_manifest(rows)), key=repr)
    assert M.prove(documents([])).count() == 0
    one = M.prove(documents([(1, "alone", "en", "s")])).first()
    assert one.leaf == one.subroot == one.root and one.proof == "" and one.proof_sha256 == sha("")
