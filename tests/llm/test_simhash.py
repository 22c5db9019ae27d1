import re
from itertools import combinations

import numpy as np
import xxhash

from plansift.llm import simhash as S


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(fps, bits=4):
    """Component (smallest index) of each fingerprint, all pairs compared."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= bits:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def slow_similar(texts, similarity=0.8):
    """Component (smallest index) of each text by Jaccard similarity of five-word shingles, all pairs with a common one."""
    sets, holders, root = [], {}, list(range(len(texts)))
    for i, t in enumerate(texts):
        w = [x.lower() for x in (t or "").encode().split()]
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))})
        for x in sets[-1]:
            holders.setdefault(x, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < i}:
            if 10 * len(s & sets[j]) >= 10 * similarity * len(s | sets[j]) - 1e-6:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_similar_texts_equal_brute_force(spark):
    """All links of the larger sample, where candidates come from fingerprints alone."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    kept = {r.doc_id for r in S.keep_one(docs).select("doc_id").collect()}
    want = {rows[i][0] for i, g in enumerate(slow_similar([t for _, t in rows])) if g == i}
    assert kept == want


def test_large_groups_are_compared_in_blocks(documents):
    """Texts that differ from one of them in a word or two; blocks far smaller than the group."""
    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    rows = []
    for i in range(80):
        words = list(base)
        for k in rng.integers(0, 120, i % 4):
            words[k] = f"x{rng.integers(0, 1000)}"
        rows.append((i, " ".join(words), "en", "s"))
    rows += [(100 + i, " ".join(f"y{x}" for x in rng.integers(0, 900, 80)), "en", "s") for i in range(40)]
    nodes, roots = S.similar_groups(documents(rows).repartition(3), "text", "doc_id", block=16)
    by, ids = {r.node: r.root for r in roots.collect()}, {r.node: r.least for r in nodes.collect()}
    groups = {}
    for node, doc in ids.items():
        groups.setdefault(by.get(node, node), set()).add(doc)
    want = {}
    for i, g in enumerate(slow_similar([r[1] for r in rows])):
        want.setdefault(g, set()).add(rows[i][0])
    texts = {}
    for d, t, *_ in rows:
        texts.setdefault(t, d)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(set(w) & set(texts.values())) for w in want.values())


def test_equals_brute_force(spark, texts):
    rows = sorted(texts)
    fps = [slow_fingerprint(t) for _, t in rows]
    groups = slow_groups(fps)
    want = {d: (f"{f:016x}", rows[g][0]) for (d, _), f, g in zip(rows, fps, groups)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op1_simhash(spark, "/root/testdata/sf0.01").collect()}
    assert got == want


def test_no_link_is_lost_in_deep_trees_and_divided_leaves(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 3000, np.uint64)
    near = x[:600].copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 600, np.uint64)
    chain = [np.uint64((1 << (4 * i)) - 1) for i in range(15)]
    fps = np.unique(np.concatenate([x, near, np.array(chain, np.uint64)]))
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long").repartition(4)
    edges = S.near_links(df, leaf_rows=40, sample_rows=2000, chunk_rows=300)
    index = {int(v): i for i, v in enumerate(fps.view(np.int64))}
    groups = S.Groups(len(fps))
    pairs = np.array([(index[r.a], index[r.b]) for r in edges.collect()])
    groups.add(pairs[:, 0], pairs[:, 1])
    assert all(int(fps[a] ^ fps[b]).bit_count() <= 64 for a, b in pairs)
    d = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    root = np.arange(len(fps))
    while True:
        new = np.array([root[row].min() for row in d])
        if (new == root).all():
            break
        root = new
    assert (groups.merge() == root).all()


def test_keep_one(documents, edge_rows):
    docs = documents(edge_rows)
    kept = S.keep_one(docs)
    rows = kept.collect()
    # one of the texts without words, one of the prose (lower-cased alike), and the two others
    assert sorted((r.doc_id for r in rows)) == [1, 5, 7, 8] and kept.columns == docs.columns
    assert S.keep_one(documents([])).count() == 0
    lone = S.keep_one(documents([edge_rows[3], edge_rows[4]])).collect()
    assert len(lone) == 1 and lone[0].doc_id is None


def test_edges(documents, edge_rows):
    rows = S.near_duplicates(documents(edge_rows)).collect()
    assert len(rows) == len(edge_rows)
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint == "0" * 16 and by[3].component_id == 1
    assert by[None].component_id == by[6].component_id == 5
    assert S.near_duplicates(documents([])).count() == 0
