from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plansift.llm import mixing as M


def slow_fill(amount, rooms, weights):
    """Amounts by weight, capped by room; what is over goes to those with room, until none is over."""
    given, open_ = {k: 0.0 for k in rooms}, {k for k in rooms if weights[k] > 0}
    while open_:
        unit = (amount - sum(given[k] for k in rooms if k not in open_)) / sum(weights[k] for k in open_)
        full = {k for k in open_ if rooms[k] <= unit * weights[k] + 1e-9}
        if not full:
            for k in open_:
                given[k] = unit * weights[k]
            break
        for k in full:
            given[k] = float(rooms[k])
        open_ -= full
    return given


def slow_budgets(supply, weights, budget, epochs, levels):
    out = {}

    def down(prefix, amount):
        depth = len(prefix)
        if depth == len(levels):
            out[prefix] = amount
            return
        rooms = defaultdict(float)
        for path, tokens in supply.items():
            if path[:depth] == prefix:
                rooms[path[depth]] += tokens * epochs
        w = {k: weights.get(levels[depth], {}).get(k, 1.0) for k in rooms}
        for k, x in slow_fill(amount, rooms, w).items():
            down((*prefix, k), x)
    down((), budget)
    return out


@pytest.mark.parametrize("share, epochs", [(0.5, 1), (0.8, 2), (1.7, 2), (9.0, 2)])
def test_equals_brute_force(spark, share, epochs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    levels = M.default_levels()
    got = defaultdict(list)
    for r in M.mix(docs, levels, M.WEIGHTS, share, epochs).collect():
        got[tuple(r.mix_levels)].append((r.doc_id, r.mix_epoch))
    base = docs.select("doc_id", *[c.alias(f"l{i}") for i, c in enumerate(levels.values())],
                       F.expr(r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')").alias("n"), F.xxhash64("doc_id", "text").alias("h"),
                       *[F.xxhash64(F.xxhash64("doc_id", "text"), F.lit(42), F.lit(e)).alias(f"h{e}") for e in range(3)]).collect()
    supply, rows = defaultdict(int), defaultdict(list)
    for r in base:
        path = (r.l0, r.l1, r.l2)
        supply[path] += r.n
        rows[path].append(r)
    budgets = slow_budgets(supply, M.WEIGHTS, sum(supply.values()) * share, epochs, list(levels))
    for path, amount in budgets.items():
        whole = min(epochs, int(amount / supply[path] + 1e-12)) if supply[path] else 0
        want = [(r.doc_id, e) for r in rows[path] for e in range(whole)]
        left = int(amount - whole * supply[path] + 1e-6)
        for r in sorted(rows[path], key=lambda r: r[f"h{whole}"]):
            left -= r.n
            if left < 0:
                break
            want.append((r.doc_id, whole))
        # a leaf that is taken whole has no tokens left over, so only texts without words could follow
        assert sorted(x for x in got[path] if x[1] < whole or whole < epochs) == sorted(x for x in want if x[1] < whole or whole < epochs), path


def test_siblings_come_before_ancestors(documents):
    text = "a b c d e f g h i j"
    rows = [(i, text, "en", "s1") for i in range(2)] + [(10 + i, text, "en", "s2") for i in range(50)]
    rows += [(100 + i, text, "de", "s3") for i in range(50)]
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    got = M.mix(documents(rows), levels, {}, share=600 / 1020, epochs=1).groupBy("lang", "source").count().collect()
    # 300 a language; s1 has 20 of its 150, and s2 takes the rest of 300 before any goes to the other language
    assert {(r.lang, r.source): r["count"] for r in got} == {("en", "s1"): 2, ("en", "s2"): 28, ("de", "s3"): 30}


def test_edges(documents, edge_rows):
    docs = documents(edge_rows)
    out = M.mix(docs, M.default_levels(), M.WEIGHTS, share=5.0, epochs=1)
    assert out.columns[:len(docs.columns)] == docs.columns
    assert {r.doc_id for r in out.collect()} >= {None, 5, 6, 7, 8}
    assert M.mix(documents([]), M.default_levels(), M.WEIGHTS).count() == 0
    assert M.mix(documents(edge_rows[:3]), M.default_levels(), M.WEIGHTS).count() >= 0


def test_plan_is_native(spark):
    plan = M.op6_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
