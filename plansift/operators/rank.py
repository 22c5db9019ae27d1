"""Page ranking: lexical candidates, dense candidates, evidence score, confidence."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plansift.catalogue import page_title_text
from plansift.functions import refs as R, text as T, vectors as X
from plansift.operators import fts
from plansift.operators.relational import rows_of, top_per_key, within_budget
from plansift.sources import text_index, vector_index
from plansift.staging import pinned, small
from plansift.vocab import Vocabulary

# fixed values: weights of the evidence score
DENSE_WEIGHT, COVERAGE_WEIGHT, ALL_WORDS_BONUS, PHRASE_BONUS = 1.4, 0.9, 0.35, 0.4
SYNONYM_BONUS, SYNONYM_LIMIT = 0.06, 5
SYSTEM_BONUS, OTHER_SYSTEM_PENALTY, REF_BONUS = 0.8, 0.45, 1.2
THIN_PAGE_CHARS, THIN_PAGE_PENALTY = 120, 0.25
DRAWING_BONUS, DRAWING_STEP, DRAWING_LIMIT = 0.25, 0.08, 4
DENSE_CONFIDENCE_CAP = 0.75
POOL_FACTOR, POOL_FLOOR, DENSE_FLOOR = 6, 40, 15
# fixed values: limits of the evidence text handed on with an answer
BODY_CHARS, CONTEXT_CHARS = 2600, 12000


def understand(questions: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``qid, question`` plus everything ranking needs to know about the question."""
    q = F.col("question")
    read = questions.select("qid", "question", T.search_words(q).alias("base"))
    return (read.withColumn("expanded", T.expand(F.col("base"), vocabulary))
            .withColumn("asked_system", T.system_named(q, vocabulary))
            .withColumn("typed_refs", R.typed_refs(q))
            .withColumn("is_ref", T.is_reference_query(q))
            .withColumn("wants_drawings", T.wants_drawings(q)))


def indexed_pages(pages: DataFrame) -> DataFrame:
    """Page columns as they enter the full-text index."""
    return pages.select(
        "page_id", F.concat_ws(" ", "text", T.blank_to_empty(F.col("summary"))).alias("text"), "refs",
        page_title_text().alias("title"), "ocr_text")


def page_index(pages: DataFrame, path: str | None = None) -> text_index.TextIndex:
    """Full-text index over the pages, laid out by title."""
    return text_index.build(indexed_pages(pages), "page_id", list(fts.PAGE_WEIGHTS), path, near=("title",))


def semantic_hits(page_vectors: DataFrame, query_vectors: DataFrame, k: int = DENSE_FLOOR,
                  index: vector_index.VectorIndex | None = None) -> DataFrame:
    """``qid, page_id, cos, dense_rank``: the k nearest pages of every query vector.

    With the stored ``index`` only the cells that can hold a neighbour are read; without it every
    vector is compared, by one matrix product a batch and with a top-k in each task.
    """
    hits = index.nearest(query_vectors, k) if index else vector_index.nearest_rows(
        page_vectors.select("page_id", "vec"), query_vectors, k)
    return hits.withColumnRenamed("rank", "dense_rank")


def candidates(scored: DataFrame, pool: int, dense: DataFrame | None = None) -> DataFrame:
    """``qid, page_id, bm, strict, position, cos``: the pool of pages to be scored.

    Pages with every word come first; the wide query only fills up a pool the
    strict one left short; dense neighbours not seen so far close the list.  A
    page keeps its dense similarity whichever list it comes from.
    """
    def listed(df, stage_no, rank_column, bm, cos):
        return df.select("qid", "page_id", F.lit(stage_no).alias("stage"), F.col(rank_column).alias("rank"),
                         bm.alias("bm"), cos.alias("cos"))

    unknown = F.lit(None).cast("double")
    strict = top_per_key(scored.filter("all_score is not null"), ["qid"],
                         [F.asc("all_score"), F.asc("page_id")], pool)
    wide = top_per_key(scored, ["qid"], [F.asc("any_score"), F.asc("page_id")], pool)
    rows = listed(strict, 0, "rank", F.col("all_score"), unknown).unionByName(
        listed(wide, 1, "rank", F.col("any_score"), unknown))
    if dense is not None:
        rows = rows.unionByName(listed(dense, 2, "dense_rank", F.lit(0.0), F.col("cos")))
    n_strict = F.count_if(F.col("stage") == 0).over(Window.partitionBy("qid"))
    open_rows = rows.withColumn("n_strict", n_strict).filter(
        (F.col("stage") != 1) | (F.col("n_strict") < pool))
    place = F.col("stage") * 1_000_000 + F.col("rank")
    firsts = open_rows.groupBy("qid", "page_id").agg(
        F.min_by("bm", place).alias("bm"), F.min("stage").alias("stage"), F.min(place).alias("position"),
        F.max("cos").alias("cos"))
    return firsts.select("qid", "page_id", "bm", (F.col("stage") == 0).alias("strict"), "position", "cos")


def drawing_counts(figures: DataFrame) -> DataFrame:
    return figures.filter(F.col("kind") == "drawing").groupBy("page_id").agg(
        F.count(F.lit(1)).alias("figure_count"))


def _coverage(base, low):
    found = F.size(F.filter(base, lambda t: F.contains(low, t)))
    return found.cast("double") / F.size(base)


def _evidence(joined: DataFrame) -> DataFrame:
    """Score of each candidate from text, references, system and dense similarity."""
    base, expanded = F.col("base"), F.col("expanded")
    body = F.concat(T.blank_to_empty(F.col("text")), F.lit(" "), T.blank_to_empty(F.col("ocr_text")))
    rows = joined.withColumn("body", body).withColumn("low", F.lower("body"))
    low = F.col("low")
    by_question = Window.partitionBy("qid")
    lexical = F.when(F.col("bm") < 0, F.col("bm"))
    best, worst = F.min(lexical).over(by_question), F.max(lexical).over(by_question)
    span = F.when(worst - best == 0, F.lit(1.0)).otherwise(worst - best)
    rows = rows.withColumn("lexical", F.coalesce((worst - lexical) / span, F.lit(0.0)))
    rows = rows.withColumn("full_coverage", _coverage(base, low))
    synonyms = F.size(F.filter(expanded, lambda t: ~F.array_contains(base, t) & F.contains(low, t)))
    ref_hit = F.arrays_overlap("typed_refs", "refs")
    all_systems = F.array_union("systems", F.array("system"))

    def points(condition, value, otherwise=0.0):
        return F.when(condition, F.lit(value)).otherwise(F.lit(otherwise))

    rows = rows.withColumn("ref_hit", ref_hit).withColumn("systems", F.array_sort(all_systems))
    score = (F.col("lexical")
             + F.coalesce(F.lit(DENSE_WEIGHT) * F.greatest(F.col("cos"), F.lit(0.0)), F.lit(0.0))
             + F.lit(COVERAGE_WEIGHT) * F.col("full_coverage")
             + points(F.col("strict"), ALL_WORDS_BONUS)
             + points((F.size(base) > 1) & F.contains(low, F.array_join(base, " ")), PHRASE_BONUS)
             + F.lit(SYNONYM_BONUS) * F.least(synonyms, F.lit(SYNONYM_LIMIT))
             + F.when(F.col("asked_system").isNull(), F.lit(0.0)).otherwise(
                 points(F.array_contains("systems", F.col("asked_system")), SYSTEM_BONUS,
                        -OTHER_SYSTEM_PENALTY))
             + points(F.col("ref_hit"), REF_BONUS)
             - points(F.length(T.strip(F.col("body"))) < THIN_PAGE_CHARS, THIN_PAGE_PENALTY))
    return (rows.withColumn("raw_score", F.bround(score, 3))
            .withColumn("coverage", F.bround("full_coverage", 2)))


def _with_drawings(rows: DataFrame, figures: DataFrame | None, pages: DataFrame) -> DataFrame:
    if figures is None:
        return rows.withColumn("figure_count", F.lit(0).cast("bigint"))
    counts = small(drawing_counts(figures.join(pages, "page_id", "left_semi")), "drawing-counts")
    n = F.when(F.col("wants_drawings"), F.coalesce("figure_count", F.lit(0))).otherwise(F.lit(0))
    boost = F.when(n > 0, F.lit(DRAWING_BONUS) + F.lit(DRAWING_STEP) * F.least(n, F.lit(DRAWING_LIMIT)))
    return (rows.join(counts, "page_id", "left").withColumn("figure_count", n)
            .withColumn("raw_score", F.col("raw_score") + F.coalesce(boost, F.lit(0.0))))


def confidence(rows: DataFrame) -> DataFrame:
    """Displayed percentage: evidence found on the page, not its rank."""
    semantic = F.bround("cos", 3)
    named = F.when(F.col("ref_hit"), F.lit(1.0)).otherwise(F.col("coverage"))
    shown = F.when(semantic.isNull(), named).otherwise(
        F.greatest(named, F.least(F.lit(DENSE_CONFIDENCE_CAP), semantic)))
    return (rows.withColumn("semantic", semantic).withColumn("score", X.percent(shown))
            .withColumn("supported", (F.col("coverage") > 0) | F.col("ref_hit")))


def search_pages(pages: DataFrame, questions: DataFrame, vocabulary: Vocabulary, limit: int = 8,
                 figures: DataFrame | None = None, page_vectors: DataFrame | None = None,
                 query_vectors: DataFrame | None = None,
                 index: text_index.TextIndex | None = None,
                 vectors: vector_index.VectorIndex | None = None) -> DataFrame:
    """Ranked pages per question, best first (``rank`` from 1).

    ``index`` and ``vectors`` are the stored indexes; without the first, the pages are indexed first.  Only the
    candidate pool ever meets page text.
    """
    asked = small(understand(questions, vocabulary), "questions")
    pool = max(limit * POOL_FACTOR, POOL_FLOOR)
    scored = text_index.top_pages(index or page_index(pages), "page_id", fts.PAGE_WEIGHTS, fts.phrase_rows(asked), pool)
    dense = None
    if page_vectors is not None and query_vectors is not None:
        prose = asked.filter(~F.col("is_ref")).select("qid")
        dense = semantic_hits(page_vectors, query_vectors.join(prose, "qid", "left_semi"),
                              max(limit, DENSE_FLOOR), vectors)
    chosen, rows = pinned(candidates(scored, pool, dense), "candidates")
    joined = rows_of(pages, "page_id", rows).join(chosen if rows is None else F.broadcast(chosen), "page_id").join(asked, "qid")
    rows = confidence(_with_drawings(_evidence(joined), figures, chosen.select("page_id")))
    rows = rows.filter(~F.col("is_ref") | F.col("supported"))
    top = top_per_key(rows, ["qid"], [F.desc("raw_score"), F.asc("position")], limit)
    shown_text = F.coalesce(F.nullif("text", F.lit("")), F.col("ocr_text"))
    return top.select(
        "qid", "rank", "page_id", "doc_id", "filename", "title", "system", "systems", "doc_kind",
        "page_num", "raw_score", "coverage", "ref_hit",
        T.snippet(shown_text, F.col("expanded")).alias("snippet"),
        (F.length(T.strip(F.col("ocr_text"))) > 0).alias("has_ocr"), "semantic",
        T.strip(T.blank_to_empty(F.col("summary"))).alias("summary"), "refs",
        T.page_image(F.col("filename"), F.col("page_num")).alias("page_image"),
        T.page_image(F.col("filename"), F.col("page_num"), "_thumb").alias("thumb"),
        "figure_count", "score", "supported", "text", "ocr_text")


def evidence_block(rows: DataFrame) -> DataFrame:
    """``block``: head line and readable body of a ranked page, null when empty."""
    raw, ocr = T.strip(T.blank_to_empty(F.col("text"))), T.strip(T.blank_to_empty(F.col("ocr_text")))
    chosen = (F.when((ocr != "") & (F.length(ocr) > F.length(T.clean_text(raw))), ocr)
              .when(ocr != "", F.concat(raw, F.lit("\n"), ocr)).otherwise(raw))
    chosen = F.when(chosen == "", F.col("snippet")).otherwise(chosen)
    rows = rows.withColumn("evidence", T.strip(F.regexp_replace(T.clean_text(chosen), "\n{3,}", "\n\n")))
    body = F.when(F.length("evidence") > BODY_CHARS,
                  F.concat(F.substring("evidence", 1, BODY_CHARS), F.lit("…"))).otherwise(F.col("evidence"))
    head = F.concat(F.lit("["), F.col("system"), F.lit(" · "), T.base_name(F.col("filename")), F.lit(" · p."),
                    F.col("page_num").cast("string"), F.lit(" ("), F.col("doc_kind"), F.lit(")]"))
    return rows.withColumn("block", F.when(F.col("evidence") != "", F.concat(head, F.lit("\n"), body)))


def build_context(ranked: DataFrame, max_chars: int = CONTEXT_CHARS) -> DataFrame:
    """``qid, context``: evidence blocks in rank order that fit the character budget."""
    blocks = evidence_block(ranked).filter("block is not null").withColumn("cost", F.length("block"))
    kept = within_budget(blocks, ["qid"], [F.asc("rank")], "cost", max_chars)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "block")))
    return kept.groupBy("qid").agg(
        F.array_join(F.transform(ordered, lambda s: s["block"]), "\n\n").alias("context"))


def signature(ranked: DataFrame) -> DataFrame:
    """``qid, signature``: the ranked pages as ``file@page`` joined by bars."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "filename", "page_num")))
    return ranked.groupBy("qid").agg(F.array_join(F.transform(
        ordered, lambda s: F.concat(s["filename"], F.lit("@"), s["page_num"].cast("string"))), "|")
        .alias("signature"))
