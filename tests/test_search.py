import math
import re

import pytest
from pyspark.sql import functions as F

from plansift.functions import text as T
from plansift.operators import facets, fts, rank
from plansift.sources import text_index
from plansift.vocab import Vocabulary

VOCAB = Vocabulary(system_aliases={"S1": ("s1 ",)})
TEXTS = [
    (1, "Glazing bead for the door. Glazing beads!", "S1"), (2, "broom seal joint brosse", "S2"),
    (3, "hinge hinge hinge weight 120 kg", "S1"), (4, "glazing unit and seal", "S2"),
    (5, "nothing of note here but padding " * 6, "S1"), (6, "door door door", "S3"),
]


@pytest.fixture(scope="module")
def pages(table):
    df = table("page_id long, text string, system string", TEXTS)
    return df.select("page_id", F.lit("d1").alias("doc_id"), F.col("page_id").cast("int").alias("page_num"), "text",
                     F.lit("").alias("ocr_text"), F.lit("").alias("summary"), F.array().cast("array<string>").alias("refs"),
                     F.concat("system", F.lit("/doc.pdf")).alias("filename"), F.lit("Title").alias("title"), "system",
                     F.array("system").alias("systems"), F.lit("brochure").alias("doc_kind"))


@pytest.fixture(scope="module")
def questions(table):
    return table("qid int, question string", [(1, "glazing bead"), (2, "door hinge s1 "), (3, "the the seal"), (4, "zzz")])


def brute_bm25(docs, phrases):
    """Scores of {doc: [(weight, tokens)]} for {phrase: multiplicity}, by the formula."""
    lengths = {d: sum(len(toks) for _, toks in cols) for d, cols in docs.items()}
    average = sum(lengths.values()) / len(docs)
    scores = {}
    for phrase, times in phrases.items():
        tf = {d: sum(w * sum(t.startswith(phrase) for t in toks) for w, toks in cols) for d, cols in docs.items()}
        n = sum(v > 0 for v in tf.values())
        idf = math.log((len(docs) - n + 0.5) / (n + 0.5)) if n else 0
        idf = idf if idf > 0 else 1e-6
        for d, v in tf.items():
            if v:
                gain = idf * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * lengths[d] / average))
                scores[d] = scores.get(d, 0) - times * gain
    return scores


def word_list(text):
    return re.findall(r"[a-z0-9]+", text.lower())


def test_bm25_equals_the_formula(spark, pages, questions):
    asked = rank.understand(questions, VOCAB)
    rows = text_index.search(rank.page_index(pages), "page_id", fts.PAGE_WEIGHTS, fts.phrase_rows(asked)).collect()
    docs = {i: [(1.0, word_list(t)), (3.0, word_list(f"title {s} brochure"))] for i, t, s in TEXTS}
    for q in asked.collect():
        wide = brute_bm25(docs, {w: 1 for w in q.expanded})
        got = {r.page_id: r.any_score for r in rows if r.qid == q.qid}
        assert got == pytest.approx(wide, abs=1e-8)
        strict = brute_bm25(docs, {w: q.base.count(w) for w in q.base})
        full = {d for d, cols in docs.items()
                if all(any(t.startswith(w) for _, toks in cols for t in toks) for w in q.base)}
        got = {r.page_id: r.all_score for r in rows if r.qid == q.qid and r.all_score is not None}
        assert got == pytest.approx({d: strict[d] for d in full}, abs=1e-8)


def scores(df):
    return {(r.qid, r.page_id): (r.all_score, r.any_score) for r in df.collect()}


def full_search(spark, path, phrases):
    return scores(text_index.search(text_index.TextIndex(spark, path), "page_id", fts.PAGE_WEIGHTS, phrases))


def test_postings_count_terms_before_they_are_shuffled(spark, table):
    rows = [(1, "b a b", "x"), (2, "", None), (1, "a c", "x x"), (None, "a a", "y"), (3, None, "é E")]
    found = fts.postings(table("page_id long, text string, title string", rows), "page_id", ["text", "title"])
    assert sorted(map(tuple, found.collect()), key=str) == sorted([
        (1, "text", "a", 2), (1, "text", "b", 2), (1, "text", "c", 1), (1, "title", "x", 3), (None, "text", "a", 2),
        (None, "title", "y", 1), (3, "title", "e", 2)], key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # one row a page reaches the exchange


def test_tokens_of_a_block_are_counted_in_one_task(spark, pages, tmp_path, monkeypatch):
    """No row a token is grouped by Spark, and buckets follow the tokens, not only the pages."""
    monkeypatch.setattr(text_index, "BUCKET_TOKENS", 20)
    monkeypatch.setattr(text_index, "BLOCK_PAGES", 4)
    seen, explode = [], F.explode
    monkeypatch.setattr(text_index.F, "explode", lambda *a: seen.append(a) or explode(*a))
    docs = spark.range(60).selectExpr("id page_id", "concat('w', id % 7, ' both both') text", "'t' title")
    text_index.write_segment(docs, "page_id", ["text", "title"], str(tmp_path / "i"))
    index = text_index.TextIndex(spark, str(tmp_path / "i"))
    assert not seen and index.segments[0]["buckets"] == 12
    rows = index.blocks(0).select("block", "term", F.explode("pages").alias("p"), "m0", "d0", "mask").collect()
    assert sorted((r.p.page, r.term, r.p.f0, r.p.f1, r.p.len) for r in rows) == sorted(
        row for i in range(60) for row in ((i, f"w{i % 7}", 1, 0, 4), (i, "both", 2, 0, 4), (i, "t", 0, 1, 4)))
    for r in rows:
        mine = [x.p for x in rows if (x.block, x.term) == (r.block, r.term)]
        assert r.m0 == max(p.f0 for p in mine) and r.d0 == r.m0 / 4 and r.mask == sum(1 << p.slot for p in mine)


def test_segments_equal_a_rebuild(spark, pages, questions, tmp_path):
    """New, changed, repeated and deleted pages: the segments together search like one fresh index."""
    phrases, columns = fts.phrase_rows(rank.understand(questions, VOCAB)), list(fts.PAGE_WEIGHTS)
    docs, path = rank.indexed_pages(pages), str(tmp_path / "index")
    text_index.write_segment(docs.filter("page_id <= 3"), "page_id", columns, path, 0)
    for _ in range(2):  # the second load repeats the first, as after a failed attempt
        text_index.write_segment(docs.filter("page_id > 3"), "page_id", columns, path, 1)
    want = scores(text_index.search(text_index.build(docs, "page_id", columns), "page_id", fts.PAGE_WEIGHTS, phrases))
    assert want and full_search(spark, path, phrases) == want

    changed = docs.filter("page_id in (1, 4)").withColumn("text", F.lit("door seal beads, door"))
    text_index.write_segment(changed, "page_id", columns, path, 2)
    text_index.write_segment(changed.filter("page_id = 4").withColumn("text", F.lit("")), "page_id", columns, path, 3)
    text_index.delete_pages(spark, path, docs.filter("page_id = 2").select(F.col("page_id").alias("page")), 9)
    now = docs.filter("page_id in (3, 5, 6)").unionByName(changed.filter("page_id = 1")).unionByName(
        changed.filter("page_id = 4").withColumn("text", F.lit("")))
    fresh = text_index.build(now, "page_id", columns)
    opened = text_index.TextIndex(spark, path)
    assert (opened.n, opened.total_len) == (fresh.n, fresh.total_len) and opened.n == 5
    want = scores(text_index.search(fresh, "page_id", fts.PAGE_WEIGHTS, phrases))
    assert want and full_search(spark, path, phrases) == want
    assert scores(text_index.top_pages(opened, "page_id", fts.PAGE_WEIGHTS, phrases, 2)) == scores(
        text_index.top_pages(fresh, "page_id", fts.PAGE_WEIGHTS, phrases, 2))
    share = {r.phrase: r.share for r in text_index.page_share(opened, fts.PAGE_WEIGHTS, phrases).collect()}
    assert share["door"] == pytest.approx(2 / 5) and share["zzz"] == 0


def test_streamed_pages_are_found(spark, pages, questions, tmp_path):
    from plansift.streaming import intake
    docs = rank.indexed_pages(pages)
    incoming, path = str(tmp_path / "incoming"), str(tmp_path / "index")
    docs.coalesce(1).filter("page_id <= 4").write.parquet(incoming)

    def load():
        stream = spark.readStream.schema(docs.schema).parquet(incoming)
        intake.index_stream(stream, "page_id", list(fts.PAGE_WEIGHTS), path, str(tmp_path / "state")).awaitTermination()
    load()
    docs.coalesce(1).filter("page_id >= 4").write.mode("append").parquet(incoming)  # page 4 comes again
    load()
    index = text_index.TextIndex(spark, path)
    assert index.n == len(TEXTS)

    def found(index):
        return [(r.qid, r["rank"], r.page_id, r.raw_score) for r in rank.search_pages(pages, questions, VOCAB, 4, index=index).collect()]
    assert sorted(found(index)) == sorted(found(None)) and {r[2] for r in found(index)} >= {5, 6} - {5}


def many_pages(spark):
    """A page table whose words differ in frequency, with many equal scores."""
    words = F.concat_ws(" ", *[F.when(F.expr(f"pmod(hash(id, {i}), {i + 2})") == 0, F.repeat(F.lit(f"word{i} "), i % 3 + 1)) for i in range(12)])
    return spark.range(2000).select(F.col("id").alias("page_id"), F.concat(words, F.lit(" x"), F.expr("repeat(' filler', cast(id % 40 as int))")).alias("text"))


def test_best_pages_open_fewer_blocks(spark, table):
    docs = many_pages(spark)
    index = text_index.build(docs, "page_id", ["text"])
    weights, k = {"text": 1.0}, 10
    words = [(1, ["word10", "word9"]), (2, ["word"]), (3, ["x", "word5"]), (4, ["word1", "word2", "word3"]), (5, ["none"])]
    rows = [(q, w, 1, 1) for q, ws in words for w in ws]
    phrases = table("qid int, phrase string, n_all long, n_any int", rows)
    everything = text_index.search(index, "page_id", weights, phrases).collect()
    best = {(r.qid, r.page_id): (r.all_score, r.any_score) for r in text_index.top_pages(index, "page_id", weights, phrases, k).collect()}
    for q, _ in words:
        for column in ("any_score", "all_score"):
            want = sorted((r[column], r.page_id) for r in everything if r.qid == q and r[column] is not None)[:k]
            at = ("all_score", "any_score").index(column)
            got = sorted((v[at], p) for (qid, p), v in best.items() if qid == q and v[at] is not None)[:k]
            assert got == want, (q, column)
    matched = text_index.Matched(index, phrases)
    held = text_index.phrase_blocks(index, matched, weights)
    uses = text_index.weighted_uses(index, held, matched)
    bounded = text_index.bounds(held, uses)
    opened = text_index.first_blocks(bounded, k)
    scored = text_index.score(index, matched, uses, weights, "page_id", opened)
    left = text_index.blocks_left(bounded, opened, scored, k, "page_id")
    per_question = [{r.qid: r["count"] for r in df.groupBy("qid").count().collect()} for df in (bounded, opened, left)]
    assert sum(per_question[1].values()) + sum(per_question[2].values()) < sum(per_question[0].values())
    assert per_question[1][1] + per_question[2].get(1, 0) < per_question[0][1]
    plan = text_index.score(index, matched, uses, weights, "page_id", opened)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SelectedBucketsCount" in plan
    # a bound is never below a score of its block
    bound = {(r.qid, r.block): (r.any_bound, r.all_bound) for r in bounded.collect()}
    place = {r.page: r.block for r in spark.read.parquet(f"{index.path}/pages").collect()}
    for r in everything:
        assert -r.any_score <= bound[r.qid, place[r.page_id]][0] + 1e-8
        assert r.all_score is None or -r.all_score <= bound[r.qid, place[r.page_id]][1] + 1e-8


def test_search_without_broadcasts(spark, pages, questions):
    phrases = fts.phrase_rows(rank.understand(questions, VOCAB))
    index = rank.page_index(pages)
    want = full_search(spark, index.path, phrases)
    kept = text_index.pinned
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    text_index.pinned = lambda df, label: (text_index.stage(df, label), None)  # as if nothing were small
    try:
        assert full_search(spark, index.path, phrases) == want
        top = scores(text_index.top_pages(text_index.TextIndex(spark, index.path), "page_id", fts.PAGE_WEIGHTS, phrases, 3))
        assert top and all(want[k] == v for k, v in top.items())
    finally:
        text_index.pinned = kept
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_single_letters_count(spark, table):
    docs = table("page_id long, text string", [(1, "a b c"), (2, "bb"), (3, "é x"), (4, None), (5, "")])
    phrases = table("qid int, phrase string, n_all long, n_any int", [(1, "b", 1, 1), (2, "e", 1, 1), (3, "a", 1, 1), (3, "x", 1, 1)])
    got = text_index.search(text_index.build(docs, "page_id", ["text"]), "page_id", {"text": 1.0}, phrases).collect()
    assert sorted((r.qid, r.page_id, r.all_score is None) for r in got) == [(1, 1, False), (1, 2, False), (2, 3, False), (3, 1, True), (3, 3, True)]


def test_confidence_is_evidence_not_rank(spark, pages, questions, table):
    vectors = table("page_id long, vec doubles", [(i, [float(i == 5), float(i != 5)]) for i, _, _ in TEXTS])
    queries = table("qid int, vec doubles", [(1, [1.0, 0.0]), (4, [1.0, 0.0])])
    rows = rank.search_pages(pages, questions, VOCAB, 6, page_vectors=vectors, query_vectors=queries).collect()
    for r in rows:
        if r.coverage == 1.0:
            assert r.score == 100
        elif not r.supported:
            assert r.score <= 75
        else:
            assert r.score < 100
    first = {r.qid: r for r in rows if r["rank"] == 1}
    assert first[1].page_id == 5 or first[1].page_id == 1
    assert first[2].page_id in (1, 3) and first[2].system == "S1"
    assert {r.page_id for r in rows if r.qid == 4} == {i for i, _, _ in TEXTS}  # dense neighbours only
    assert len({(r.qid, r.page_id) for r in rows}) == len(rows)


def test_reference_questions_keep_supported_pages_only(pages, table):
    questions = table("qid int, question string", [(1, "120"), (2, "999")])
    rows = rank.search_pages(pages, questions, VOCAB, 6).collect()
    assert [(r.qid, r.page_id, r.semantic) for r in rows] == [(1, 3, None)]


def test_strict_pool_keeps_the_wide_query_out(spark, table):
    scored = table("qid int, page_id long, all_score double, any_score double", [
        (1, p, -2.0 if p <= 3 else None, -1.0 - p) for p in range(1, 8)])
    small = {r.page_id for r in rank.candidates(scored, 3).collect()}
    large = {r.page_id: r.strict for r in rank.candidates(scored, 4).collect()}
    assert small == {1, 2, 3}
    assert large == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False}


def test_context_stops_at_the_first_overflow(table):
    rows = table("qid int, rank int, system string, filename string, page_num int, doc_kind string, text string, snippet string", [
        (1, 1, "S", "a/b.pdf", 1, "k", "short", ""), (1, 2, "S", "a/b.pdf", 2, "k", "   ", ""),
        (1, 3, "S", "a/b.pdf", 3, "k", "word " * 900, ""), (1, 4, "S", "a/b.pdf", 4, "k", "tail", "")])
    rows = rows.withColumn("ocr_text", F.lit(""))
    [full] = rank.build_context(rows).collect()
    assert full.context.startswith("[S · b.pdf · p.1 (k)]\nshort\n\n[S · b.pdf · p.3 (k)]") and full.context.endswith("tail")
    assert "…" in full.context and "p.2" not in full.context
    [cut] = rank.build_context(rows, 500).collect()
    assert cut.context == "[S · b.pdf · p.1 (k)]\nshort"
    assert rank.signature(rows).collect()[0].signature == "a/b.pdf@1|a/b.pdf@2|a/b.pdf@3|a/b.pdf@4"


def test_suggestions_interleave_and_stop_at_six(table):
    questions = table("qid int, question string", [(1, "doors"), (2, "doors s1 ")])
    components = table("qid int, rank int, family string", [(q, i, f"Family {i}") for q in (1, 2) for i in range(1, 7)])
    heads = table("qid int, rank int, heading string", [(1, 1, "family 2"), (1, 2, "Track"), (2, 1, "Track")])
    found = table("qid int, systems strings, doc_kinds strings", [(1, ["S1", "S2"], ["fabrication drawing"]), (2, ["S1"], ["x"])])
    got = {}
    for r in sorted(facets.suggestions(questions, components, heads, found, VOCAB).collect(), key=lambda r: (r.qid, r["rank"])):
        got.setdefault(r.qid, []).append(r.suggestion)
    assert got[1] == ["Family 1", "Family 2", "Family 3", "Family 4", "Track", "What does S1 cover?"]
    assert got[2] == [f"Family {i} — S1" for i in range(1, 5)] + ["Track — S1"]


def test_autocomplete_merges_three_sources(table):
    vocabulary = Vocabulary(prompts=("Glazing bead", "Punching tools"))
    typed = table("qid int, question string", [(1, "bead"), (2, "b")])
    near = table("qid int, rank int, ref string", [(1, 1, "BEAD1"), (1, 2, "BEAD2")])
    found = table("qid int, rank int, ref string", [(1, 1, "bead1"), (1, 2, "X9"), (2, 1, "X9")])
    got = [r.suggestion for r in sorted(facets.autocomplete(typed, near, found, vocabulary).collect(), key=lambda r: r["rank"])]
    assert got == ["BEAD1", "BEAD2", "X9", "Glazing bead"]


@pytest.mark.parametrize("question, ref, pages_, share, coverage, score, broad", [
    ("?", False, 3, 0.0, 1.0, 100, True), ("what is 10230A", True, 0, 0.0, None, None, False),
    ("give me info", False, 3, 0.0, 1.0, 100, True), ("hello there friend of mine", False, 3, 0.0, 1.0, 100, True),
    ("windmill", False, 0, 0.0, None, None, True), ("Doors", False, 3, 0.0, 1.0, 100, True),
    ("aluminum profiles", False, 3, 0.0, 1.0, 100, True), ("ontion", False, 3, 0.5, 1.0, 100, True),
    ("thermal break", False, 3, 0.0, 1.0, 100, False), ("blue ontion", False, 3, 0.0, 0.0, 40, True),
    ("ontion", False, 3, 0.1, 0.5, 50, True), ("ontion", False, 3, 0.1, 1.0, 100, False)])
def test_breadth(table, question, ref, pages_, share, coverage, score, broad):
    df = table("q string, s double, c double, n int", [(question, share, coverage, score)])
    got = df.select(facets.is_broad(F.col("q"), F.lit(ref), F.lit(pages_), F.col("s"), F.col("c"), F.col("n"), VOCAB)).collect()
    assert got[0][0] is broad


def test_families_count_every_matching_part(spark, table):
    from plansift.operators import facets
    from plansift.vocab import Vocabulary
    rows = [(i, f"A{i}", f"A{i}", "part", "", f"BROOM FIRST {i % 2}") for i in range(700)]
    rows += [(1000 + i, f"B{i}", f"B{i}", "part", "", "LATE BROOM") for i in range(900)]
    parts = table("part_id long, ref string, ref_norm string, kind string, supplier_ref string, designation string", rows)
    got = facets.component_families(table("qid int, question string", [(1, "brooms")]), parts, Vocabulary()).collect()
    assert [r.n for r in sorted(got, key=lambda r: r["rank"])][0] == 900


def test_a_count_of_zero_is_no_size(table):
    from plansift.plans.ask import with_limits
    rows = with_limits(table("qid int, question string, max_pages int", [(1, "seals on 0 pages", 7), (2, "seals on 0 pages", 0), (3, "seals on 5 pages", 7)]))
    assert {r.qid: r.max_pages for r in rows.collect()} == {1: 7, 2: 3, 3: 5}


def test_pages_that_match_are_found_without_their_lists(spark, pages, questions, tmp_path):
    phrases, columns = fts.phrase_rows(rank.understand(questions, VOCAB)), list(fts.PAGE_WEIGHTS)
    docs, path = rank.indexed_pages(pages), str(tmp_path / "index")
    text_index.write_segment(docs.filter("page_id <= 3"), "page_id", columns, path, 0)
    text_index.write_segment(docs.filter("page_id >= 3"), "page_id", columns, path, 1)
    text_index.delete_pages(spark, path, docs.filter("page_id = 2").select(F.col("page_id").alias("page")), 9)
    index = text_index.TextIndex(spark, path)
    want = sorted((r.qid, r.page_id) for r in text_index.search(index, "page_id", fts.PAGE_WEIGHTS, phrases).collect())
    found = text_index.matching(index, "page_id", phrases)
    assert want and sorted((r.qid, r.page_id) for r in found.collect()) == want
    assert "explode(pages#" not in found._jdf.queryExecution().optimizedPlan().toString()
