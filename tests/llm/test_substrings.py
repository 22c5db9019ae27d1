import hashlib
import re

import duckdb
import numpy as np
import pytest

from plansift.llm import substrings as S
from plansift.llm.base import Words


def slow_removal(rows, window=13):
    """(id, n_words, n_removed, sha) by a table of all windows."""
    last = 1 << 63
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            first[k] = min(first.get(k, last), last if d is None else d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i:i + window])] < (last if d is None else d):
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_query_equals_duckdb_and_brute_force(spark, texts):
    got = rows_of(S.op2_substrings(spark, "/root/testdata/sf0.01"))
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS FROM '/root/testdata/sf0.01/documents.parquet'")
    assert got == slow_removal(texts) == sorted(con.execute(S.ORACLE).fetchall(), key=str)
    assert sum(r[2] for r in got) > 1000


@pytest.mark.parametrize("seed", [1, 2])
def test_random_overlaps(documents, seed):
    """Repeats of any length at any place, few different words, ids out of order."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in rng.permutation(60).tolist():
        words = [f"w{x}" for x in rng.integers(0, 400, rng.integers(0, 120))]
        for _ in range(2):
            if rows and rng.random() < 0.7:
                other = rows[rng.integers(len(rows))][1].split()
                a = int(rng.integers(0, max(1, len(other))))
                at = int(rng.integers(0, len(words) + 1))
                words[at:at] = other[a:a + int(rng.integers(5, 40))]
        rows.append((i, " \n".join(words), "en", "s"))
    assert rows_of(S.remove_repeats(documents(rows).repartition(3))) == slow_removal([r[:2] for r in rows])


def test_edges(documents, edge_rows):
    rows = [r for r in edge_rows if r[0] != 8] + [(8, edge_rows[-1][1][:4000], "en", "s"), (9, edge_rows[5][1] + " tail", "en", "s"),
                                                  (9, "other text of the same id " + edge_rows[5][1], "en", "s")]
    assert rows_of(S.remove_repeats(documents(rows))) == slow_removal([r[:2] for r in rows])
    assert S.remove_repeats(documents([])).count() == 0
    assert S.remove_repeats(documents(edge_rows[:3])).count() == 3


def test_steps_and_words():
    at = np.array([0, 0, 254, 509, 510, 2000, 2255])
    assert S.unpack_steps(S.pack_steps(at)).tolist() == at.tolist()
    texts = ["a b\n a", "", "é a  ", "ab"]
    words = Words([t.encode() for t in texts])
    assert words.count.tolist() == [3, 0, 2, 1] and words.first.tolist() == [0, 3, 3, 5, 6]
    assert words.hash[0] == words.hash[2] == words.hash[4] != words.hash[5]
    starts, hashes = words.windows(2)
    assert starts.tolist() == [0, 1, 3] and len(set(hashes.tolist())) == 3
