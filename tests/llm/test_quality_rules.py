import duckdb
import pytest

from plansift.llm import quality_rules as Q


def test_equals_duckdb(spark):
    got = {r.doc_id: tuple(r) for r in Q.op4_quality_rules(spark, "/root/testdata/sf0.01").collect()}
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS FROM '/root/testdata/sf0.01/documents.parquet'")
    assert got == {r[0]: r for r in con.execute(Q.ORACLE).fetchall()}


def test_labels(spark):
    """Documents marked good are kept, most of those marked bad are not."""
    docs = Q.op4_quality_rules(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = docs.join(labels, "doc_id").collect()
    good = [r.kept or r.base_failed for r in rows if r.quality == 1]
    bad = [not r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) > 0.6


@pytest.mark.parametrize("line, why", [
    ("A plain sentence that ends as it should.", None), ("Short heading", "punctuation"), ("Yes, it did.", None),
    ("# a $ b % c & d *", "punctuation"), ("BUY! NOW! IT! IS! CHEAP!", "punctuation"),
    ("one | two thing | three more | four and some others", "navigation"), ("Home of the site map page", "navigation"),
    ("All Rights Reserved by the makers of this text.", "boilerplate")])
def test_line_rules(line, why):
    assert Q.line_failure(line, Q.Rules()) == why


def test_repeats_count_overlapping_windows_once():
    assert Q.repeated_words("a b c a b c".split()) == 6
    assert Q.repeated_words("a a a a".split()) == 4
    assert Q.repeated_words("a b c d a b c".split()) == 6
    assert Q.repeated_words(["a"]) == 0


def test_edges_and_cleaning(documents, edge_rows):
    docs = documents([*edge_rows, (9, "Home\n" + " ".join(f"w{i}" for i in range(60)) + ".\nAll rights reserved", "en", "src1")])
    rows = Q.quality(docs, keep=("doc_id", "lang")).collect()
    assert len(rows) == 11
    assert [(r.n_words, r.base_failed, r.kept) for r in rows[:3]] == [(0, True, False)] * 3
    kept = Q.clean(docs).collect()
    assert {r.doc_id for r in kept} == {9}  # the others have too few words or repeat themselves
    last = next(r for r in kept if r.doc_id == 9)
    assert "Home" not in last.text and "rights" not in last.text and last.n_chars == len(last.text)
    assert last.fp == "fp10" and Q.clean(docs).columns == docs.columns
    assert Q.clean(documents([])).count() == 0
