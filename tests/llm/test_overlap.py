import itertools

import numpy as np
import pyarrow as pa
import pytest

from plansift.llm import overlap as O
from plansift.llm import simhash as S

VOCABULARY = [f"w{i}" for i in range(5000)]


def jaccard(a, b):
    a, b = (set(zip(*(t.lower().split()[k:] for k in range(5)))) for t in (a, b))
    return len(a & b) / max(1, len(a | b))


def edited(rng, words, kind, share):
    n, at = int(len(words) * share), int(rng.integers(0, len(words) // 2))
    if kind == "insertion":
        return words[:at] + list(rng.choice(VOCABULARY, n)) + words[at:]
    if kind == "cut":
        return words[:at] + words[at + n:]
    return words[:-n]


@pytest.fixture(scope="module")
def pairs():
    """Pairs of texts near the threshold on both sides, where one has a passage more or less."""
    rng, made = np.random.default_rng(7), []
    for k in range(240):
        words = list(rng.choice(VOCABULARY, (60, 400, 900)[k % 3]))
        kind = ("insertion", "cut", "truncation")[k // 3 % 3]
        share = (.10, .15, .19, .21, .24)[k // 9 % 5] if kind == "insertion" else (.10, .13, .16, .18, .19)[k // 9 % 5]
        made.append((" ".join(words), " ".join(edited(rng, words, kind, share))))
    return made


def test_no_pair_with_a_long_passage_more_or_less_is_missed(documents, pairs):
    rows = [(2 * i + k, t, "en", "s") for i, p in enumerate(pairs) for k, t in enumerate(p)]
    kept = {r.doc_id for r in S.keep_one(documents(rows).repartition(4)).select("doc_id").collect()}
    linked = {2 * i + 1 for i, p in enumerate(pairs) if jaccard(*p) >= 0.8}
    near = [jaccard(*p) for p in pairs]
    assert sum(0.8 <= x < 0.82 for x in near) > 20 and sum(0.75 < x < 0.8 for x in near) > 5
    assert {d for d, *_ in rows} - kept == linked


def key_of(text):
    import hashlib
    return O.text_id(hashlib.md5(b" ".join(text.lower().encode().split())).hexdigest())


@pytest.mark.parametrize("often", [True, False])
def test_edges_join_every_similar_pair(documents, monkeypatch, often):
    """A passage in most texts, copies in thirds, repeated words, texts of few words; with and without frequent shingles."""
    if not often:
        monkeypatch.setattr(O, "SAMPLE_HITS", 1 << 30)
    monkeypatch.setattr(O, "BUCKET_TEXT", 5000)
    rng = np.random.default_rng(11)
    passage = list(rng.choice(VOCABULARY, 60))
    texts = ["", "one", "one two three", "One two three", "a " * 300, "a " * 40]
    for i in range(150):
        own = list(rng.choice(VOCABULARY, int(rng.integers(1, 40))))
        texts.append(" ".join(passage + own if i % 2 else own + passage[:50]))
    texts += [texts[10]] * 70
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    edges = O.prefix_links(documents(rows).repartition(5), "text").collect()
    root = {key_of(t): key_of(t) for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for e in edges:
        root[find(e.a)] = find(e.b)
    found = 0
    for x, y in itertools.combinations(sorted(set(texts)), 2):
        if jaccard(x, y) >= 0.8:
            found += 1
            assert find(key_of(x)) == find(key_of(y)), (x, y)
    assert found > 100
    assert len(edges) < 150 * 80  # a text lists a shingle once for a band, never a partner for each


def test_edges_of_no_and_odd_rows(documents, edge_rows):
    assert O.prefix_links(documents([]), "text").count() == 0
    assert O.prefix_links(documents(edge_rows), "text").count() == 0  # all different, or equal in words


def test_bytes_of_a_column_are_joined_without_copies_of_rows():
    column = pa.chunked_array([pa.array([b"skipped", b"ab", None, b"c"]).slice(1), pa.array([], pa.binary()), pa.array([b"def"])])
    assert bytes(O._joined(column)) == b"abcdef"
    assert isinstance(O._joined(pa.chunked_array([pa.array([b"a", b"b"])])), memoryview)
    assert bytes(O._joined(pa.chunked_array([], pa.binary()))) == b""
