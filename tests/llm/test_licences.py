import math
import re

import pytest
from pyspark.sql import functions as F

from plansift.llm import licences as L


def slow_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow_scan(rows, templates=L.TEMPLATES, index=L.Index()):
    """{doc_id: (n_words, n_base, first, last, base labels, labels, score)} by plain loops over every start."""
    texts = [slow_words(t) for _, t in rows]
    vocabulary = {w for t in templates for x in (t.text, *t.keys) for w in slow_words(x)} | {w for p, _ in L.PHRASES for w in p.split()}
    idf = {w: math.log((len(rows) + 1) / (sum(w in t for t in map(set, texts)) + 1)) + 1 for w in vocabulary}
    out = []
    for (doc, _), words in zip(rows, texts):
        base = sorted((i, label) for p, label in L.PHRASES for i in range(len(words)) if words[i:i + len(p.split())] == p.split())
        labels, score = {label for _, label in base}, 1.0 if base else 0.0
        here = set(words)
        for t in templates:
            ids, keys = slow_words(t.text), [slow_words(k) for k in t.keys]
            rare = sorted(set(ids), key=lambda w: (-idf[w], w))[:index.rare]
            need, slack = math.ceil(index.agree * len(rare)), max(2, math.ceil(index.slack * len(ids)))
            if len(here & set(rare)) < need:
                continue
            best = None
            for s in range(-len(ids), len(words)):
                if not any(words[s + q] == w for q, w in enumerate(ids) if w in rare and 0 <= s + q < len(words)):
                    continue
                near = lambda q, w: w in words[max(0, s + q):max(0, s + q + slack + 1)]  # noqa: B023, E731
                if sum(any(near(q, x) for q, x in enumerate(ids) if x == w) for w in rare) < need:
                    continue
                if not all(any(words[p:p + len(k)] == k for p in range(max(0, s), max(0, s + len(ids) + slack - len(k) + 1))) for k in keys):
                    continue
                share = sum(idf[w] for q, w in enumerate(ids) if near(q, w)) / sum(idf[w] for w in ids)
                best = max(best or 0, share)
            if best is not None:
                labels.add(t.label)
                score = max(score, best)
        out.append((doc, len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
                    ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score))
    return sorted(out, key=repr)


def check(made, expected):
    made = sorted((tuple(r) for r in made), key=repr)
    assert [r[:7] for r in made] == [r[:7] for r in expected]
    assert [r[7] for r in made] == pytest.approx([r[7] for r in expected])


def test_query_equals_brute_force(spark, texts):
    made = L.op12_licences(spark, "/root/testdata/sf0.01").collect()
    check(made, slow_scan(texts))
    assert {r.labels for r in made} >= {"", "mit", "apache-2", "cc-by-nc", "gpl-3"}
    text = dict(texts)
    assert all(("gpl-3" in r.labels) == ("GNU General Public License, version 3" in text[r.doc_id]) for r in made)


def test_every_template_is_found_and_only_with_its_phrases(documents):
    filler = "plain words of another kind stand here and say nothing of the matter " * 5
    rows = [(i, f"{filler}\n# {t.text}. {filler}", "en", "s") for i, t in enumerate(L.TEMPLATES)]
    rows += [(100, "the license of the general public is under version 3 of this work gnu", "en", "s"),
             (101, "Permission was granted to any person to use this software free of charge without restriction", "en", "s"),
             (102, filler, "en", "s"), (103, "Apache licence, Version 2", "en", "s")]
    docs = documents(rows)
    made = {r.doc_id: r for r in L.scan_licences(docs).collect()}
    for i, t in enumerate(L.TEMPLATES):
        assert t.label in made[i].labels.split(","), t
        assert any(p.label == t.label and p.first_word == 65 and p.score == pytest.approx(1) for p in made[i].places), t
    assert all(made[i].labels == "" and made[i].score == 0 for i in (100, 101, 102, 103))
    check(L.scan_licences(docs).drop("places").collect(), slow_scan([r[:2] for r in rows]))


def test_changed_notices(documents):
    """A word more or less, other line breaks and marks, several notices in a file, one notice many times."""
    gpl = "redistribute it and / or modify it under the terms of the GNU General\n * Public License as published by the Free Software " \
          "Foundation, either version 3 of the License, or (at your own option) any later version"
    rows = [(1, "x " * 50 + gpl, "en", "s"), (2, "Released under the MIT License. " * 400, "en", "s"),
            (3, "Licensed under CC BY-SA 4.0\n" + gpl + "\nLicensed under the Apache License, Version 2.0", "en", "s")]
    made = {r.doc_id: r for r in L.scan_licences(documents(rows)).collect()}
    assert made[1].labels == "gpl-3" and 0.5 < made[1].score < 1
    assert made[2].n_base == 400 and (made[2].first_word, made[2].last_word) == (1, 1 + 5 * 399) and len(made[2].places) >= 100
    assert made[3].labels == "apache-2,cc-by-sa,gpl-3" and made[3].base_labels == "apache-2"


def test_edges(documents, edge_rows):
    rows = [*edge_rows, (20, "under the MIT license", "en", "s"), (21, "CC BY-NC", None, None), (22, "éCC BY NC", "fr", "s"),
            (23, "a" * 200_000 + " cc by nc", "en", "s"), (24, "\x00cc\x7fby\x00nc", "en", "s"), (25, "cc by", "en", "s")]
    docs = documents(rows)
    check(L.scan_licences(docs).drop("places").collect(), slow_scan([r[:2] for r in rows]))
    assert L.scan_licences(documents([])).count() == 0
    two = L.scan_licences(docs.repartition(5).withColumn("base", F.lit(1)), templates=L.TEMPLATES[:1]).drop("places").collect()
    check(two, slow_scan([r[:2] for r in rows], L.TEMPLATES[:1]))
