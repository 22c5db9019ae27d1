import zlib
from collections import defaultdict

import numpy as np

from plansift.llm import sharding as S


def slow_jump(key, shards):
    key %= 1 << 64
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * S.MULTIPLIER + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_query_equals_brute_force(spark, texts):
    rows = S.op5_sharding(spark, "/root/testdata/sf0.01").collect()
    text, slots = dict(texts), defaultdict(list)
    for r in rows:
        data = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "key")
        assert (r.shard, r.grown_shard) == (slow_jump(r.doc_id, 24), slow_jump(r.doc_id, 25))
        slots[r.shard].append((r.slot, r.doc_id))
    assert len(rows) == len(texts) and len(slots) == 24
    for x in slots.values():
        x.sort()
        assert [s for s, _ in x] == list(range(len(x))) and [d for _, d in x] == sorted(d for _, d in x)


def test_only_the_new_shard_takes_rows():
    keys = np.arange(200_000, dtype=np.uint64)
    for n in (1, 7, 24):
        a, b = S.jump(keys, n), S.jump(keys, n + 1)
        assert (b[a != b] == n).all() and abs((a != b).mean() - 1 / (n + 1)) < 0.01
    counts = np.bincount(S.jump(keys, 24))
    assert counts.max() / counts.mean() < 1.1 and counts.min() / counts.mean() > 0.9
    odd = np.array([0, 1, (1 << 64) - 1, 1 << 63], np.uint64)
    assert S.jump(odd, 24).tolist() == [slow_jump(int(k), 24) for k in odd]


def test_edges(documents, edge_rows):
    rows = S.shard_documents(documents(edge_rows)).collect()
    assert len(rows) == len(edge_rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.shard == slow_jump(r.doc_id or 0, 24)
        if r.doc_id in (1, 2):
            assert (r.size, r.text_crc32) == (8, 0)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert S.shard_documents(documents([])).count() == 0
    by_name = S.shard_documents(documents(edge_rows), key="lang").collect()
    assert len({r.shard for r in by_name if r.doc_id == "en"}) == 1
