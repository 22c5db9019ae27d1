import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest

from plansift.llm import lm_scoring as L
from plansift.llm.base import Words


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def opening_of(lang):
    return b" " if lang is None else L.CLASSES[(zlib.crc32(lang.encode()) >> 16) % len(L.CLASSES):][:1]


class SlowClasses:
    """Classes by word counts in dictionaries."""

    def __init__(self, texts):
        self.counts, self.size = defaultdict(Counter), Counter()
        for text, lang in texts:
            for slot in self.slots(text):
                self.counts[opening_of(lang)][slot] += 1
                self.size[opening_of(lang)] += 1

    def slots(self, text):
        return [int(h) % L.SLOTS for h in Words([(text or "").encode()], lower=True).hash]

    def of(self, text):
        if not self.size:
            return b" "
        fit = {c: log10(n / self.size.total()) + sum(log10((self.counts[c][s] + 0.5) / (n + 0.5 * L.SLOTS)) for s in self.slots(text))
               for c, n in sorted(self.size.items())}
        return max(fit, key=fit.get)


class SlowTrie:
    """The same model in dictionaries, symbol by symbol."""

    def __init__(self, texts, order, share):
        self.classes = SlowClasses(texts)
        self.order, self.counts = order, [defaultdict(Counter) for _ in range(order + 1)]
        for text, lang in texts:
            opening = self.classes.of(text)
            for w in [0, *words_of(text), None]:
                for context, symbol in self.symbols(w, opening):
                    for k in range(order + 1):
                        self.counts[k][context[max(0, len(context) - k):] if k else b""][symbol] += 1
        total = sum(self.counts[0][b""].values())
        least = max(2, int(np.ceil(total * share)))
        self.total = [{c: sum(n.values()) for c, n in level.items() if sum(n.values()) >= least} for level in self.counts]
        self.kept = [{c: {s: n for s, n in level[c].items() if n >= least} for c in t} for level, t in zip(self.counts, self.total)]

    def symbols(self, word, opening):
        data = opening if word == 0 else b"\n" if word is None else word.encode() + b" "
        before = b"\n" if word == 0 else opening
        for i in range(len(data)):
            yield before[-self.order:] if self.order else b"", data[i]
            before += data[i:i + 1]

    def log10(self, context, symbol):
        out, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            c = context[max(0, len(context) - k):] if k else b""
            if c not in self.total[k]:
                continue
            kept = {s: n for s, n in self.kept[k][c].items() if s not in excluded}
            total = self.total[k][c] - sum(self.kept[k][c].get(s, 0) for s in excluded)
            if total <= 0:
                continue
            if symbol in kept:
                return out + log10((kept[symbol] - 0.5) / total)
            out += log10((total - sum(kept.values()) + len(kept) / 2) / total)
            excluded |= set(kept)
        return out - log10(256 - len(excluded))

    def text(self, text):
        opening = self.classes.of(text)
        return sum(self.log10(c, s) for w in [0, *words_of(text), None] for c, s in self.symbols(w, opening))


def slow_base(rows):
    learns = [d is None or zlib.crc32(str(d).encode()) % 5 != 1 for d, _ in rows]
    counts = Counter()
    for (d, t), l in zip(rows, learns):
        if l:
            counts.update([*words_of(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for (d, t), l in zip(rows, learns):
        tokens = [*words_of(t), None]
        out.append((d, not l, len(tokens), sum(counts[w] > 0 for w in tokens), n,
                    sum(log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)))
    return out


def compare(got, rows, order, share):
    key = lambda r: (str(r[0]), r[2], r[5])
    want = sorted(slow_base([r[:2] for r in rows]), key=key)
    got = sorted(map(tuple, got), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    slow = SlowTrie([(t, lang) for d, t, lang in rows if d is None or zlib.crc32(str(d).encode()) % 5 != 1], order, share)
    scores = defaultdict(list)
    for g in got:
        scores[g[0]].append(g[6])
    for d, t, lang in rows:
        want = slow.text(t)
        assert min(abs(s - want) for s in scores[d]) < 1e-6 * max(1, abs(want))


def test_base_of_query_and_gain(spark, texts):
    got = L.op10_lm_scoring(spark, "/root/testdata/sf0.01").toPandas().sort_values("doc_id")
    assert len({opening_of(x) for x in ("en", "de", "fr", "es", None)}) == 5
    want = sorted(slow_base(texts))
    assert list(zip(got.doc_id, got.held_out, got.n_tokens, got.n_known, got.train_tokens)) == [w[:5] for w in want]
    assert np.allclose(got.base_score, [w[5] for w in want], rtol=1e-9)


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    """The base gives every unseen word the same share of nothing; still the trie is ahead from some thousand documents on."""
    got = L.op10_lm_scoring(spark, "/root/testdata/sf0.1").toPandas()
    held = got[got.held_out]
    assert len(held) > 1500 and held.score.sum() > held.base_score.sum()


@pytest.mark.parametrize("order, share", [(7, 2.0 ** -20), (3, 0.002), (0, 0.01)])
def test_equals_slow_model(spark, documents, texts, order, share):
    rows = [(d, t[:300], ("en", "de", None)[d % 3], "s") for d, t in texts[:60]]
    got = L.score_texts(documents(rows).repartition(3), order, share).collect()
    compare(got, [r[:3] for r in rows], order, share)


def test_probabilities_add_up(spark, documents, texts):
    docs = documents([(d, t[:2000], "en", "s") for d, t in texts[:100]]).selectExpr("text AS body")
    trie = L.learn(docs, share=0.0005)
    for context in (b" ", b" th", b"nd", b"xqzzk", b"\x00\x00\x00\x00 ", b" thaaaa"):
        code = int.from_bytes(context[-7:], "big") << 8
        p = 10 ** trie.log10(np.array([code | s for s in range(256)], np.uint64))
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()


def test_classes_follow_the_text_alone(spark, documents, texts):
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").selectExpr("text AS body", "lang")
    classes = L.learn_classes(rows.select("body", L.class_byte("lang").alias("opening")))
    some = [r for r in rows.limit(1500).collect() if len(words_of(r.body)) >= 20]
    got = [bytes([classes.of(Words([r.body.encode()], lower=True))[0]]) for r in some]
    assert sum(g == opening_of(r.lang) for g, r in zip(got, some)) >= 0.95 * len(some)
    pair = documents([(1011, texts[0][1], "en", "s"), (1011, texts[0][1], "de", "s"), *((d, t[:500], "de", "s") for d, t in texts[1:20])])
    assert len({r.score for r in L.score_texts(pair).collect() if r.doc_id == 1011}) == 1


def test_codes():
    words = Words([b"ab  C", b"abcdefghij"], lower=True)
    code, word = L.symbol_codes(words, np.array([0, 1, 2]), np.array([32, 32]), 5)
    text = [int(c).to_bytes(6, "big").lstrip(b"\0") for c in code]
    assert text[:5] == [b" a", b" ab", b" ab ", b" c", b" c "] and text[-1] == b"fghij " and word.tolist()[:5] == [0, 0, 0, 1, 1]


def test_edges(documents, edge_rows):
    rows = [r for r in edge_rows if r[0] != 8] + [(8, "long text of it " * 3000, "en", "s"), (11, "", "en", "s"), (12, "zzz unseen", "en", "s")]
    compare(L.score_texts(documents(rows)).collect(), [r[:3] for r in rows], L.ORDER, L.SHARE)
    assert L.score_texts(documents([])).count() == 0
    assert L.score_texts(documents(edge_rows[:2])).count() == 2


class WholeTrie(SlowTrie):
    """The model with every branch that was counted, over contexts that run across words."""

    def __init__(self, texts, order):
        self.classes = SlowClasses(texts)
        self.order, self.counts = order, [defaultdict(Counter) for _ in range(order + 1)]
        for text, _ in texts:
            for context, symbol in self.stream(text):
                for k in range(order + 1):
                    self.counts[k][context[max(0, len(context) - k):] if k else b""][symbol] += 1
        self.kept = [{c: dict(n) for c, n in level.items()} for level in self.counts]
        self.total = [{c: sum(n.values()) for c, n in level.items()} for level in self.counts]

    def stream(self, text):
        opening = self.classes.of(text)
        symbols = opening + b"".join(w.encode() + b" " for w in words_of(text)) + b"\n"
        data = b"\n" + opening + b"".join(w.encode() + opening for w in words_of(text)) + b"\n"
        for i, s in enumerate(symbols):
            yield data[max(0, i + 1 - self.order):i + 1], s

    def text(self, text):
        return sum(self.log10(c, s) for c, s in self.stream(text))


def test_no_context_is_cut(spark, documents, texts, monkeypatch):
    """Scores of the query's model follow from all counted contexts, also those seen once."""
    rows = [(d, t[:300], ("en", "de", None)[d % 3], "s") for d, t in texts[:60]]
    monkeypatch.setattr(L, "table", lambda *_: documents(rows).repartition(3))
    got = {r.doc_id: r.score for r in L.op10_lm_scoring(spark, "").collect()}
    slow = WholeTrie([(t, lang) for d, t, lang, _ in rows if zlib.crc32(str(d).encode()) % 5 != 1], L.ORDER)
    for d, t, *_ in rows:
        assert abs(got[d] - slow.text(t)) < 1e-6 * abs(slow.text(t))


def test_shuffled_words_score_lower(spark, documents, texts, monkeypatch):
    rng = np.random.default_rng(6)
    train = [(d, t, "en", "s") for d, t in texts[:400] if zlib.crc32(str(d).encode()) % 5 != 1]
    held = [t for d, t in texts[:400] if zlib.crc32(str(d).encode()) % 5 == 1 and len(words_of(t)) >= 30][:20]
    ids = [d for d in range(10 ** 6, 10 ** 6 + 1000) if zlib.crc32(str(d).encode()) % 5 == 1]
    mixed = [" ".join(rng.permutation(words_of(t))) for t in held]
    rows = train + [(ids[i], t, "en", "s") for i, t in enumerate(held)] + [(ids[100 + i], t, "en", "s") for i, t in enumerate(mixed)]
    monkeypatch.setattr(L, "table", lambda *_: documents(rows).repartition(3))
    got = {r.doc_id: r.score for r in L.op10_lm_scoring(spark, "").collect()}
    gains = [got[ids[i]] - got[ids[100 + i]] for i in range(len(held))]
    assert len(held) == 20 and sum(g > 0 for g in gains) >= 18 and sum(gains) > 0


def shuffled(spark):
    """Bytes that all tasks so far wrote to shuffles."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_sections_ask_for_each_symbol_once(spark):
    """Few bytes travel for each byte of text: symbols that come again in a section are not asked for again."""
    size = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").selectExpr("sum(octet_length(text))").first()[0]
    before = shuffled(spark)
    assert L.op10_lm_scoring(spark, "/root/testdata/sf0.1").count() == 10_000
    assert size < shuffled(spark) - before < 2.5 * size


def test_scores_do_not_depend_on_sections(spark, documents, texts, monkeypatch):
    rows = [(d, t, "en", "s") for d, t in texts[:200]]
    monkeypatch.setattr(L, "table", lambda *_: documents(rows).repartition(2))
    whole = {r.doc_id: r.score for r in L.op10_lm_scoring(spark, "").collect()}
    monkeypatch.setattr(L, "SECTION_BYTES", 10_000)
    parts = {r.doc_id: r.score for r in L.op10_lm_scoring(spark, "").collect()}
    assert parts.keys() == whole.keys() and all(abs(parts[d] - s) <= 1e-9 * abs(s) for d, s in whole.items())
