import hashlib
import zlib
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest

from plansift.llm import conversations as C


def slow_trie(rows):
    """Nodes of (conv_id, turn, role, text) rows by plain dictionaries of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    members = defaultdict(list)
    made = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        first = abs(c) // 100 * 100 * (1 if c > 0 else -1)
        made[c] = turns.get(first, [])[:h] + turns[c][h:]
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for path, who in members.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(who) - 1) * len(path[-1][1].decode()) if path else 0
            leaves[path[:d]] += children[path] == 0
    out = []
    for path, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(made[c]) == len(path)))
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), children[path], leaves[path],
                    saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def conversations(spark):
    def make(rows):
        c = list(zip(*rows)) if rows else [()] * 4
        data = {"conv_id": pa.array(c[0], pa.int64()), "turn": pa.array(c[1], pa.int64()), "role": pa.array(c[2], pa.string()),
                "text": pa.array(c[3], pa.string())}
        data |= {n: pa.array([n] * len(rows), pa.string()) for n in ("part", "pos", "block", "t0", "depth", "row", "id")}
        return spark.createDataFrame(pa.table(data))
    return make


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_brute_force_and_sql(spark):
    folder = "/root/testdata/sf0.01"
    made = tuples(C.op11_conversations(spark, folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    assert made == slow_trie(con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall())
    assert sorted(con.execute(C.ORACLE).fetchall(), key=repr) == made


def test_long_and_shared_conversations(conversations):
    """Paths over many blocks, shared starts of all lengths, one start that most have, repeated conversations."""
    rows = [(100, i, "user" if i % 2 else "bot", f"t{i % 7}" if i < 40 else f"long {i}") for i in range(75)]
    for c in range(101, 160):
        rows += [(c, i, "user" if i % 2 else "bot", f"t{i % 7}") for i in range(6 + c % 13)] + [(c, 99, "user", f"end {c % 3}")]
    rows += [(c, i, "user", "same") for c in range(205, 240) for i in range(3)]
    assert tuples(C.prefix_trie(conversations(rows))) == slow_trie(rows)
    assert tuples(C.prefix_trie(conversations(rows), width=2)) == slow_trie(rows)


def test_runs_are_summed_in_levels(conversations, monkeypatch):
    monkeypatch.setattr(C, "RUN", 2)
    monkeypatch.setattr(C, "PIECE", 8)
    rows = [(c, i, "user", f"text {i} {c % 2 if i > 9 else ''}") for c in range(300, 330) for i in range(9 + c % 5)]
    assert tuples(C.prefix_trie(conversations(rows), width=2)) == slow_trie(rows)


def test_edges(conversations):
    rows = [(1, None, None, None), (1, 0, "", ""), (1, 0, "", ""), (1, 0, "a", "b" * 100_000), (2, 5, "user", "é你👍"), (2, 5, "user", "é"),
            (-150, 0, "user", "x"), (-150, 1, "user", "y"), (-100, 0, "user", "first"), (None, 0, "user", "nobody"), (103, 0, "user", "alone"),
            (105, 0, None, "u"), (3, None, "user", "a"), (3, None, "user", "a"), (9_000_000_000_000_000_001, 0, "user", "far")]
    assert tuples(C.prefix_trie(conversations(rows))) == slow_trie(rows)
    assert C.prefix_trie(conversations([])).count() == 0
    plain = C.prefix_trie(conversations([(7, 0, "user", "a"), (8, 0, "user", "a"), (8, 1, "bot", "b")]), rebuilt=False)
    assert [r[:4] for r in sorted(map(tuple, plain.collect()), key=lambda r: r[1])] == [(7, 0, None, 2), (7, 1, 7, 2), (8, 2, 7, 1)]
