"""Full-text, dense and blended page search over the whole page table."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from plansift.functions import refs as R, text as T
from plansift.operators import fts, parts as P, rank
from plansift.operators.relational import top_per_key
from plansift.plans.registered import sqlparts as S
from plansift.plans.registered.inputs import QUESTIONS, question_table, question_values
from plansift.sources import standin, text_index
from plansift.staging import pinned

VOCAB = standin.VOCABULARY
QUERIES, ORACLE = {}, {}
TOP = 50


def registered(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return add


# ------------------------------------------------------------------ oracle text
def _asked_sql(questions) -> str:
    return f"""{question_values(questions)}, base_v AS (SELECT qid, question, {S.search_words('question')} AS base FROM asked),
{S.expand_steps('base_v', 'qid, question')}, understood AS (SELECT * FROM base_v_expanded),
words AS (SELECT qid, unnest(base) AS phrase, 1 AS n_all, 0 AS n_any FROM understood
 UNION ALL SELECT qid, unnest(expanded), 0, 1 FROM understood),
phrases AS (SELECT qid, phrase, sum(n_all) AS n_all, max(n_any) AS n_any FROM words GROUP BY 1, 2)"""


_ASKED = _asked_sql(QUESTIONS)


def _bm25(columns: list[tuple[str, float]], source: str) -> str:
    """CTEs ending in ``scored(qid, page_id, all_score, any_score)``."""
    rows = " UNION ALL ".join(
        f"SELECT page_id, {w}::DOUBLE AS weight, unnest({S.index_tokens(c)}) AS term FROM {source}" for c, w in columns)
    return f"""tok AS MATERIALIZED ({rows}), lens AS (SELECT page_id, count(*) AS len FROM tok GROUP BY 1),
size AS (SELECT (SELECT count(*) FROM {source}) AS n_docs, (SELECT count(*) FROM tok)::DOUBLE / (SELECT count(*) FROM {source}) AS avg_len),
vocab AS (SELECT DISTINCT term FROM tok), hit_terms AS (SELECT DISTINCT term, phrase FROM vocab JOIN (SELECT DISTINCT phrase FROM phrases) ON starts_with(term, phrase)),
freqs AS (SELECT page_id, phrase, sum(weight) AS tf FROM tok JOIN hit_terms USING (term) GROUP BY 1, 2),
dfs AS (SELECT phrase, count(*) AS n FROM freqs GROUP BY 1),
idfs AS (SELECT phrase, CASE WHEN ln((n_docs - n + 0.5e0) / (n + 0.5e0)) > 0 THEN ln((n_docs - n + 0.5e0) / (n + 0.5e0)) ELSE 1e-6 END AS idf FROM dfs, size),
gains AS (SELECT page_id, phrase, idf * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * len / avg_len)) AS gain FROM freqs JOIN idfs USING (phrase) JOIN lens USING (page_id), size),
needed AS (SELECT qid, count(*) FILTER (WHERE n_all > 0) AS n_needed FROM phrases GROUP BY 1),
sums AS (SELECT qid, page_id, round(-sum(gain * n_all), 9) AS a, round(-sum(gain * n_any), 9) AS any_score, count(*) FILTER (WHERE n_all > 0) AS n_found FROM gains JOIN phrases USING (phrase) GROUP BY 1, 2),
scored AS (SELECT qid, page_id, CASE WHEN n_found = n_needed AND n_needed > 0 THEN a END AS all_score, any_score FROM sums JOIN needed USING (qid))"""


_PAGE_COLUMNS = [("text || ' '", 1.0), ("title || ' ' || system || ' ' || doc_kind", 3.0)]
_SCORED = f"WITH {S.PAGES}, {_ASKED}, {_bm25(_PAGE_COLUMNS, 'pages_v')}"


def _asked(spark):
    return rank.understand(question_table(spark, QUESTIONS), VOCAB)


def _scored(spark, sf_dir):
    return text_index.search(standin.page_index(spark, sf_dir), "page_id", fts.PAGE_WEIGHTS, fts.phrase_rows(_asked(spark)))


def _best(spark, sf_dir, k):
    return text_index.top_pages(standin.page_index(spark, sf_dir), "page_id", fts.PAGE_WEIGHTS, fts.phrase_rows(_asked(spark)), k)


# ---------------------------------------------------------------------- queries
@registered(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({S.index_tokens('text')}) AS term FROM documents) GROUP BY 1, 2")
def postings(spark, sf_dir):
    docs = standin.spread(standin.table(spark, sf_dir, "documents"))
    return fts.postings(docs, "doc_id", ["text"]).select("doc_id", "term", "tf")


@registered(f"SELECT doc_id, len({S.index_tokens('text')})::BIGINT AS len FROM documents")
def doc_lengths(spark, sf_dir):
    docs = standin.spread(standin.table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.size(T.index_tokens(F.col("text"))).cast("bigint").alias("len"))


@registered(f"""{_SCORED} SELECT phrase, round(coalesce(n, 0) / n_docs, 6) AS share FROM (SELECT DISTINCT phrase FROM phrases) LEFT JOIN dfs USING (phrase), size""")
def page_share(spark, sf_dir):
    shares = text_index.page_share(standin.page_index(spark, sf_dir), fts.PAGE_WEIGHTS, fts.phrase_rows(_asked(spark)))
    return shares.select("phrase", F.round("share", 6).alias("share"))


@registered(f"{_SCORED} SELECT qid, page_id, round(any_score, 6) AS bm FROM scored WHERE any_score < 0")
def bm25_any_word(spark, sf_dir):
    scored = _scored(spark, sf_dir).filter("any_score < 0")
    return scored.select("qid", "page_id", F.round("any_score", 6).alias("bm"))


@registered(f"{_SCORED} SELECT qid, page_id, round(all_score, 6) AS bm FROM scored WHERE all_score IS NOT NULL")
def bm25_all_words(spark, sf_dir):
    scored = _scored(spark, sf_dir).filter("all_score is not null")
    return scored.select("qid", "page_id", F.round("all_score", 6).alias("bm"))


@registered(f"""{_SCORED} SELECT qid, page_id, bm, rank FROM (SELECT qid, page_id, round(any_score, 6) AS bm,
 row_number() OVER (PARTITION BY qid ORDER BY any_score, page_id) AS rank FROM scored) WHERE rank <= {TOP}""")
def bm25_top(spark, sf_dir):
    top = top_per_key(_best(spark, sf_dir, TOP), ["qid"], [F.asc("any_score"), F.asc("page_id")], TOP)
    return top.select("qid", "page_id", F.round("any_score", 6).alias("bm"), "rank")


_REF_ROWS = f"""{S.PARTS}, {S.PHOTOS}, known AS (SELECT ref_norm FROM parts_v UNION SELECT ref_norm FROM photos_v),
upper_v AS (SELECT page_id, upper(text) AS u FROM pages_v), cand AS (SELECT page_id, unnest({S.page_ref_candidates('u')}) AS ref_norm FROM upper_v),
found AS (SELECT page_id, ref_norm FROM cand SEMI JOIN known USING (ref_norm))"""


@registered(f"WITH {S.PAGES}, {_REF_ROWS} SELECT page_id, string_agg(ref_norm, ' ' ORDER BY ref_norm) AS refs FROM found GROUP BY 1")
def refs_in_text(spark, sf_dir):
    known = P.known_refs(standin.parts(spark, sf_dir), standin.ref_images(spark, sf_dir))
    found = P.refs_in_text(standin.pages(spark, sf_dir), known)
    return found.select("page_id", F.array_join("refs", " ").alias("refs"))


@registered(f"""WITH {S.PAGES}, {_REF_ROWS}, with_refs AS (SELECT pages_v.*, coalesce(r, '') AS refs FROM pages_v
 LEFT JOIN (SELECT page_id, string_agg(ref_norm, ' ') AS r FROM found GROUP BY 1) USING (page_id)),
{_ASKED}, {_bm25([('text', 1.0), ('refs', 8.0), _PAGE_COLUMNS[1]], 'with_refs')}
SELECT qid, page_id, round(any_score, 6) AS bm FROM scored WHERE any_score < 0""")
def bm25_weighted_columns(spark, sf_dir):
    scored = text_index.search(standin.refs_index(spark, sf_dir), "page_id", fts.PAGE_WEIGHTS, fts.phrase_rows(_asked(spark)))
    return scored.filter("any_score < 0").select("qid", "page_id", F.round("any_score", 6).alias("bm"))


# ------------------------------------------------------------------ dense search
def _question_vectors(spark, sf_dir):
    """A vector per question: the mean page vector of a label (the encoder is a plug-in)."""
    vectors = standin.page_vectors(spark, sf_dir)
    means = vectors.select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(
        F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return means.groupBy("label").agg(F.transform(ordered, lambda s: s["x"]).alias("vec")).select(
        (F.col("label") + 1).cast("int").alias("qid"), "vec")


_SEMANTIC = """dims AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
qvecs AS (SELECT label::BIGINT + 1 AS qid, list(x ORDER BY i) AS qv FROM (SELECT label, i, avg(x) AS x FROM dims GROUP BY 1, 2) GROUP BY 1),
sims AS (SELECT qid, vec_id AS page_id, list_dot_product(embedding::DOUBLE[], qv) AS cos FROM embeddings, qvecs),
dense AS (SELECT * FROM (SELECT qid, page_id, cos, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, page_id) AS dense_rank FROM sims) WHERE dense_rank <= 15)"""


@registered(f"WITH {_SEMANTIC} SELECT qid, page_id, round(cos, 6) AS cos, dense_rank FROM dense")
def semantic_topk(spark, sf_dir):
    hits = rank.semantic_hits(standin.page_vectors(spark, sf_dir), _question_vectors(spark, sf_dir))
    return hits.select("qid", "page_id", F.round("cos", 6).alias("cos"), "dense_rank")


_NEIGHBOURS = """qs AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0),
near_v AS (SELECT qid, vec_id AS page_id, round(list_dot_product(embedding::DOUBLE[], qv), 12) AS cos FROM embeddings, qs)"""
NEIGHBOURS, PROBED_SHARE = 10, 0.7


def _neighbour_queries(spark, sf_dir):
    return standin.page_vectors(spark, sf_dir).filter(F.col("page_id") % 20 == 0).select(F.col("page_id").alias("qid"), "vec")


@registered(f"""WITH {_NEIGHBOURS} SELECT qid, page_id, round(cos, 6) AS cos, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, page_id) AS rank FROM near_v) WHERE rank <= {NEIGHBOURS}""")
def stored_neighbours(spark, sf_dir):
    """Exact neighbours of every twentieth vector, from the vector index on disk."""
    hits = standin.vectors_on_disk(spark, sf_dir).nearest(_neighbour_queries(spark, sf_dir), NEIGHBOURS)
    return hits.select("qid", "page_id", F.round("cos", 6).alias("cos"), "rank")


@registered()
def probed_neighbours(spark, sf_dir):
    """The same from the cells of the nearest centres only; its recall is in the README."""
    index = standin.vectors_on_disk(spark, sf_dir)
    hits = index.nearest(_neighbour_queries(spark, sf_dir), NEIGHBOURS, probes=math.ceil(PROBED_SHARE * len(index.cells)))
    return hits.select("qid", "page_id", F.round("cos", 6).alias("cos"), "rank")


_CANDIDATES = f"""strict AS (SELECT qid, page_id, 0 AS stage, rank, all_score AS bm FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY all_score, page_id) AS rank
 FROM scored WHERE all_score IS NOT NULL) WHERE rank <= 48),
wide AS (SELECT qid, page_id, 1 AS stage, rank, any_score AS bm FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY any_score, page_id) AS rank FROM scored) WHERE rank <= 48),
n_strict AS (SELECT qid, count(*) AS n FROM strict GROUP BY 1),
prose AS (SELECT qid FROM understood WHERE NOT {S.is_reference_query('question')}),
near AS (SELECT qid, page_id, cos, dense_rank FROM dense SEMI JOIN prose USING (qid)),
merged AS (SELECT * FROM strict UNION ALL SELECT wide.* FROM wide LEFT JOIN n_strict USING (qid) WHERE coalesce(n, 0) < 48
 UNION ALL SELECT qid, page_id, 2, dense_rank, 0.0e0 FROM near),
pool AS (SELECT qid, page_id, arg_min(bm, (stage, rank)) AS bm, min(stage) = 0 AS strict, min(stage * 1000000 + rank) AS position FROM merged GROUP BY 1, 2)"""


@registered(f"""{_SCORED}, {_SEMANTIC}, {_CANDIDATES} SELECT qid, page_id, round(bm, 6) AS bm, strict, position FROM pool""")
def hybrid_candidates(spark, sf_dir):
    dense = rank.semantic_hits(standin.page_vectors(spark, sf_dir), _question_vectors(spark, sf_dir).join(
        _asked(spark).filter(~F.col("is_ref")).select("qid"), "qid", "left_semi"))
    pool = rank.candidates(_best(spark, sf_dir, 48), 48, dense)
    return pool.select("qid", "page_id", F.round("bm", 6).alias("bm"), "strict", "position")


_RANKED = f"""{_CANDIDATES}, {S.FIGURES},
joined AS (SELECT pool.*, u.base, u.expanded, u.question, p.* EXCLUDE (page_id), near.cos, lower(text || ' ') AS low,
 {S.system_named('u.question')} AS asked_system, {S.is_reference_query('u.question')} AS is_ref,
 {S.overlaps(S.tokens('u.question'), T.V.DRAWING_WORDS)} AS wants FROM pool JOIN understood u USING (qid) JOIN pages_v p USING (page_id) LEFT JOIN near USING (qid, page_id)),
spans AS (SELECT *, min(bm) FILTER (WHERE bm < 0) OVER (PARTITION BY qid) AS best, max(bm) FILTER (WHERE bm < 0) OVER (PARTITION BY qid) AS worst,
 len(list_filter(base, lambda t: contains(low, t)))::DOUBLE / len(base) AS full_coverage,
 len(list_filter(expanded, lambda t: NOT list_contains(base, t) AND contains(low, t))) AS syn FROM joined),
evidence AS (SELECT *, round_even(CASE WHEN bm < 0 THEN (worst - bm) / (CASE WHEN worst - best = 0 THEN 1.0e0 ELSE worst - best END) ELSE 0.0e0 END
 + coalesce(1.4e0 * greatest(cos, 0.0e0), 0.0e0) + 0.9e0 * full_coverage + (CASE WHEN strict THEN 0.35e0 ELSE 0.0e0 END)
 + (CASE WHEN len(base) > 1 AND contains(low, array_to_string(base, ' ')) THEN 0.4e0 ELSE 0.0e0 END) + 0.06e0 * least(syn, 5)
 + (CASE WHEN asked_system IS NULL THEN 0.0e0 WHEN system = asked_system THEN 0.8e0 ELSE -0.45e0 END)
 - (CASE WHEN length({S.strip("text || ' '")}) < 120 THEN 0.25e0 ELSE 0.0e0 END), 3) AS score3, round_even(full_coverage, 2) AS coverage FROM spans),
counts AS (SELECT page_id, count(*) AS n FROM figures_v WHERE kind = 'drawing' GROUP BY 1),
boosted AS (SELECT evidence.*, CASE WHEN wants THEN coalesce(n, 0) ELSE 0 END AS figure_count FROM evidence LEFT JOIN counts USING (page_id)),
final AS (SELECT *, score3 + (CASE WHEN figure_count > 0 THEN 0.25e0 + 0.08e0 * least(figure_count, 4) ELSE 0.0e0 END) AS raw_score,
 round_even(cos, 3) AS semantic FROM boosted),
shown AS (SELECT *, CASE WHEN semantic IS NULL THEN coverage ELSE greatest(coverage, least(0.75e0, semantic)) END AS conf FROM final WHERE NOT is_ref OR coverage > 0),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY raw_score DESC, position) AS rank FROM shown) WHERE rank <= 8)"""
_SEARCH = f"{_SCORED}, {_SEMANTIC}, {_RANKED}"


def ranked(spark, sf_dir, limit: int = 8):
    """A few rows a question, needed more than once by most of its readers."""
    return pinned(rank.search_pages(
        standin.pages(spark, sf_dir), question_table(spark, QUESTIONS), VOCAB, limit, standin.figures(spark, sf_dir),
        standin.page_vectors(spark, sf_dir), _question_vectors(spark, sf_dir), standin.page_index(spark, sf_dir)), "ranked")[0]


@registered(f"""{_SEARCH}, {S.snippet_steps('ranked', 'qid, page_id', 'text', 'expanded')}
SELECT qid, rank, page_id, doc_id, filename, title, system, doc_kind, page_num, round(raw_score, 6) AS raw_score, coverage, semantic,
 {S.page_image('filename', 'page_num')} AS page_image, figure_count, CAST(round_even(100.0e0 * greatest(least(conf, 1.0e0), 0.0e0), 0) AS BIGINT) AS score,
 coverage > 0 AS supported, snippet FROM ranked JOIN ranked_snip USING (qid, page_id)""")
def search_pages(spark, sf_dir):
    return ranked(spark, sf_dir).select(
        "qid", "rank", "page_id", "doc_id", "filename", "title", "system", "doc_kind", "page_num",
        F.round("raw_score", 6).alias("raw_score"), "coverage", "semantic", "page_image", "figure_count",
        "score", "supported", "snippet")


#: typed references, some of them on pages of the sample tables, alone and among words and systems
REF_QUESTIONS = {1: "40", 2: "521 663", 3: "thing erth with 40 and 20 for src1 source", 4: "the ontion 15 or 743", 5: "drawings of 73", 6: "99999"}
_TYPED = f"list_transform(regexp_extract_all(u.question, {S.q(R.TYPED_REFERENCE)}), lambda t: {S.norm_ref('t')})"
_BY_REF = _RANKED
for _old, _new in (
        ("u.question, p.*", f"u.question, list_has_any({_TYPED}, string_split(p.refs, ' ')) AS ref_hit, p.*"),
        ("JOIN pages_v p USING (page_id) LEFT JOIN near", "JOIN with_refs p USING (page_id) LEFT JOIN near"),
        (" - (CASE WHEN length(", " + (CASE WHEN ref_hit THEN 1.2e0 ELSE 0.0e0 END) - (CASE WHEN length("),
        ("THEN coverage ELSE greatest(coverage,", "THEN (CASE WHEN ref_hit THEN 1.0e0 ELSE coverage END) ELSE greatest(coverage,"),
        ("WHERE NOT is_ref OR coverage > 0", "WHERE NOT is_ref OR coverage > 0 OR ref_hit")):
    assert _BY_REF.count(_old) == 1, _old
    _BY_REF = _BY_REF.replace(_old, _new)


@registered(f"""WITH {S.PAGES}, {_REF_ROWS}, with_refs AS (SELECT pages_v.*, coalesce(r, '') AS refs FROM pages_v
 LEFT JOIN (SELECT page_id, string_agg(ref_norm, ' ') AS r FROM found GROUP BY 1) USING (page_id)),
{_asked_sql(REF_QUESTIONS)}, {_bm25([('text', 1.0), ('refs', 8.0), _PAGE_COLUMNS[1]], 'with_refs')},
dense AS (SELECT qid, page_id, 0.0e0 AS cos, 1 AS dense_rank FROM understood, pages_v WHERE false), {_BY_REF}
SELECT qid, rank, page_id, round(raw_score, 6) AS raw_score, coverage, ref_hit, coverage > 0 OR ref_hit AS supported, figure_count,
 CAST(round_even(100.0e0 * greatest(least(conf, 1.0e0), 0.0e0), 0) AS BIGINT) AS score FROM ranked""")
def search_pages_by_reference(spark, sf_dir):
    """Questions that type references, over pages that carry theirs."""
    found = rank.search_pages(standin.pages_with_refs(spark, sf_dir), question_table(spark, REF_QUESTIONS), VOCAB, 8,
                              standin.figures(spark, sf_dir), index=standin.refs_index(spark, sf_dir))
    return found.select("qid", "rank", "page_id", F.round("raw_score", 6).alias("raw_score"), "coverage", "ref_hit", "supported",
                        "figure_count", "score")


_EVIDENCE = S._re(S.clean_text(S.strip("text")), "'\\n{3,}'", "chr(10) || chr(10)")


@registered(f"""{_SEARCH}, ev AS (SELECT qid, rank, system, filename, page_num, doc_kind, {S.strip(_EVIDENCE)} AS evidence FROM ranked),
blocks AS (SELECT qid, rank, '[' || system || ' · ' || regexp_extract(filename, '([^/]*)$', 1) || ' · p.' || page_num || ' (' || doc_kind || ')]' || chr(10)
 || (CASE WHEN length(evidence) > 2600 THEN left(evidence, 2600) || '…' ELSE evidence END) AS block FROM ev WHERE evidence <> ''),
running AS (SELECT *, sum(length(block)) OVER (PARTITION BY qid ORDER BY rank) AS spent FROM blocks)
SELECT qid, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM running WHERE spent <= 12000 GROUP BY 1""")
def context_budget(spark, sf_dir):
    return rank.build_context(ranked(spark, sf_dir))


@registered(f"{_SEARCH} SELECT qid, string_agg(filename || '@' || page_num, '|' ORDER BY rank) AS signature FROM ranked GROUP BY 1")
def page_signature(spark, sf_dir):
    return rank.signature(ranked(spark, sf_dir))


ASK_QUESTIONS = {
    1: "hello", 2: "a cake recipe", 3: "which profiles end in 31", 4: "what is part 143 for", 5: "14 1",
    6: "small ring seals", 7: "sliding doors", 8: "99999999", 9: "erth ontion drawings on 4 pages",
}


@registered()
def answers(spark, sf_dir):
    """Every route of a whole answer."""
    from plansift.plans.ask import answer_questions
    rows = answer_questions(standin.catalogue(spark, sf_dir), question_table(spark, ASK_QUESTIONS))
    return rows.select("qid", "route", "answer", F.array_join("terms", " ").alias("terms"),
                       F.size("pages").alias("n_pages"), F.size("images").alias("n_images"),
                       F.size("parts").alias("n_parts"), F.array_join("suggestions", " | ").alias("suggestions"))
