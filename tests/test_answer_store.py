from pyspark.sql import functions as F

from plansift.plans.ask import answer_with_store
from plansift.plans.registered.inputs import question_table
from plansift.sources import answer_store, standin


def test_versions_swap_whole(spark, table, tmp_path):
    path = str(tmp_path / "store")
    assert answer_store.read(spark, path).count() == 0
    rows = "key string, answer string, first_inserted_at long"
    answer_store.merge(spark, path, table(rows, [("a", "1", 1), ("b", "2", 2)]), 3)
    before = answer_store.read(spark, path)
    answer_store.merge(spark, path, table(rows, [("a", "new", 9), ("c", "3", 3), ("d", "4", 4)]), 3)
    assert {r.key: r.answer for r in before.collect()} == {"a": "1", "b": "2"}  # a reader keeps its version
    assert {r.key: r.answer for r in answer_store.read(spark, path).collect()} == {"b": "2", "c": "3", "d": "4"}
    # a version that was written and never announced does not count, and is written over
    table(rows, [("x", "broken", 1)]).write.parquet(f"{path}/answers/version=3")
    assert {r.key for r in answer_store.read(spark, path).collect()} == {"b", "c", "d"}
    answer_store.merge(spark, path, table(rows, [("e", "5", 5)]), 10)
    assert {r.key for r in answer_store.read(spark, path).collect()} == {"b", "c", "d", "e"}


def test_hits_and_misses(spark, table, tmp_path):
    path = str(tmp_path / "store")
    rows = "qid int, question string, signature string, answer string"
    asked = table(rows, [(1, "Hinge", "p1", "one"), (2, " hinge ", "p1", "one"), (3, "seal", None, "talk"), (4, "seal", "p2", None)])
    first = {r.qid: (r.answer, r.from_cache) for r in answer_store.answered_before(spark, path, asked, now=5).collect()}
    assert first == {1: ("one", False), 2: ("one", False), 3: ("talk", False), 4: (None, False)}
    assert answer_store.read(spark, path).count() == 1
    again = table(rows, [(1, "hinge", "p1", "other"), (2, "hinge", "p9", "moved"), (3, "seal", None, "talk")])
    second = {r.qid: (r.answer, r.from_cache) for r in answer_store.answered_before(spark, path, again, now=6).collect()}
    assert second == {1: ("one", True), 2: ("moved", False), 3: ("talk", False)}
    assert sorted(r.first_inserted_at for r in answer_store.read(spark, path).collect()) == [5, 6]
    assert answer_store.answered_before(spark, path, again.limit(0)).count() == 0


def test_second_run_answers_from_the_store(spark, tmp_path):
    path, sf = str(tmp_path / "store"), "/root/testdata/sf0.001"
    catalogue = standin.catalogue(spark, sf)
    questions = question_table(spark, {1: "hello", 2: "what is part 143 for", 3: "erth ontion drawings on 4 pages"})
    first = {r.qid: r for r in answer_with_store(catalogue, questions, path).collect()}
    assert not any(r.from_cache for r in first.values()) and len(first) == 3
    stored = answer_store.read(spark, path)
    assert stored.count() == sum(r.signature is not None for r in first.values()) >= 1
    # what the store says counts, so mark it
    answer_store.merge(spark, path, stored.select("key", F.concat(F.lit("kept: "), "answer").alias("answer"), "first_inserted_at"))
    second = {r.qid: r for r in answer_with_store(catalogue, questions, path).collect()}
    for qid, r in first.items():
        assert second[qid].from_cache == (r.signature is not None)
        assert second[qid].answer == ("kept: " + r.answer if r.signature is not None else r.answer)
        assert (second[qid].signature, second[qid].route) == (r.signature, r.route)
