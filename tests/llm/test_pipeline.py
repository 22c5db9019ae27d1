"""Every stage against a brute-force version, on what the stage before it kept; then the whole run."""
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from test_mixing import slow_budgets
from test_packing import check
from test_simhash import slow_similar
from tokenizers import Tokenizer

import corpus_pipeline as C
from plansift.llm import mixing, packing, pii, quality_rules

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for i, (_, step) in enumerate(C.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        step(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_columns_stay(steps):
    assert all(df.columns == steps[0].columns for df in steps[:-1])


def test_rules(steps):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality_rules.ORACLE}) WHERE kept").fetchall()}
    want = []
    for d, text, lang, source, _ in rows(steps[0]):
        if d in kept:
            lines = [x for x in text.split("\n") if not x.split() or quality_rules.line_failure(x, quality_rules.Rules()) is None]
            want.append((d, "\n".join(lines), lang, source, len("\n".join(lines))))
    assert sorted(rows(steps[1])) == sorted(want) and 0 < len(want) < steps[0].count()


def test_near_duplicates(steps):
    before = sorted(rows(steps[1]))
    kept = [before[i] for i, g in enumerate(slow_similar([r[1] for r in before])) if g == i]
    assert sorted(rows(steps[2])) == kept and len(kept) < len(before)


def test_personal_data(steps):
    spans = {r.doc_id: r.spans for r in pii.find_personal_data(steps[2]).collect()}
    want = []
    for d, text, lang, source, _ in rows(steps[2]):
        for kind, start, end in sorted((s.split(":") for s in spans[d].split(",") if s), key=lambda s: -int(s[1])):
            # spans of different kinds may overlap: the first one names the stretch
            text = text if text[int(start):int(end)].startswith("[") else text[:int(start)] + f"[{kind}]" + text[int(end):]
        want.append((d, text, lang, source, len(text)))
    got = rows(steps[3])
    same = sum(g == w for g, w in zip(sorted(got), sorted(want)))
    assert len(got) == len(want) and same >= len(want) - 2
    assert not any(pii.base_spans(r[1]) for r in got)


def test_mixture(spark, steps):
    levels = mixing.default_levels()
    base = steps[3].select("doc_id", *[c.alias(f"l{i}") for i, c in enumerate(levels.values())],
                           *(C.mixing.F.expr(x) for x in (r"regexp_count(text, '[^\\x20\\x09-\\x0D]+') AS n", "xxhash64(doc_id, text) AS h",
                                                          "xxhash64(xxhash64(doc_id, text), 42, 0) AS h0", "xxhash64(xxhash64(doc_id, text), 42, 1) AS h1"))).collect()
    supply, leaves = defaultdict(int), defaultdict(list)
    for r in base:
        supply[r.l0, r.l1, r.l2] += r.n
        leaves[r.l0, r.l1, r.l2].append(r)
    want = Counter()
    for path, amount in slow_budgets(supply, mixing.WEIGHTS, float(sum(supply.values())), 2, list(levels)).items():
        whole = min(2, int(amount / supply[path] + 1e-12))
        want.update({r.doc_id: whole for r in leaves[path] if whole})
        left = int(amount - whole * supply[path] + 1e-6)
        for r in sorted(leaves[path], key=lambda r: r[f"h{whole}"]) if whole < 2 else ():
            left -= r.n
            if left < 0:
                break
            want[r.doc_id] += 1
    assert Counter(r[0] for r in rows(steps[4])) == want
    assert set(rows(steps[4])) <= set(rows(steps[3])) and max(want.values()) == 2


def test_packing(steps):
    got, tok = steps[5].collect(), Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for d, text, *_ in rows(steps[4]):
        n = len(tok.encode(text, add_special_tokens=False).ids) + 1
        want.update((d, k, a, min(4096, n - a)) for k, a in enumerate(range(0, n, 4096)))
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in got) == want
    assert check(got) <= -(-sum(r.length for r in got) // 4096) + 1


def test_run_applies_the_stages(spark, steps):
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(map(tuple, C.run(spark, SF).select(*key).collect())) == Counter(map(tuple, steps[5].select(*key).collect()))
    assert [name for name, _ in C.STAGES] == ["quality rules", "near duplicates", "personal data", "mixture", "packing"]
    assert np.all([callable(f) for _, f in C.STAGES]) and C.ORACLE_SQL is None
