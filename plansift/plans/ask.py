"""Questions answered end to end: parts, pages, figures, facets, evidence text.

Every step works on the whole question table at once.  The result lists that
several steps need (ranked pages, parts) are staged: they are a few rows per
question, and staging them keeps the page text from being scanned again.
"""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from plansift.catalogue import Catalogue
from plansift.functions import refs as R, text as T
from plansift.operators import facets, figures as G, fts, parts as P, rank
from plansift.operators.relational import priority_union, top_per_key
from plansift.sources import answer_store, text_index
from plansift.staging import stage

# fixed values: result sizes
DEFAULT_PAGES, DEFAULT_IMAGES, MIN_RANKED, MIN_FIGURE_PAGES = 3, 3, 12, 6
PARTS_SHOWN, NEAR_SHOWN, PATTERN_SHOWN, PATTERN_MAX = 4, 8, 24, 200
EVIDENCE_ITEMS, EVIDENCE_CHARS = 5, 220


def broad_questions(questions: DataFrame, ranked: DataFrame, catalogue: Catalogue) -> DataFrame:
    """``qid, broad``: should each question be narrowed before it is answered?"""
    vocabulary = catalogue.vocabulary
    named = P.refs_in_question(questions, catalogue.parts, catalogue.ref_images).select(
        "qid", F.lit(True).alias("has_ref"))
    content = T.content_tokens(F.col("question"))
    single = questions.filter(F.size(content) == 1).select(
        "qid", content.alias("base"), F.array().cast("array<string>").alias("expanded"))
    rows = questions.join(named, "qid", "left")
    phrases = fts.phrase_rows(single)
    shares = text_index.page_share(catalogue.page_index or rank.page_index(catalogue.pages), fts.PAGE_WEIGHTS, phrases)
    rows = rows.join(phrases.select("qid", "phrase").join(shares, "phrase").select("qid", "share"), "qid", "left")
    top = ranked.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_pages"), F.max(F.when(F.col("rank") == 1, F.col("coverage"))).alias("coverage"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"))
    return rows.join(top, "qid", "left").select("qid", facets.is_broad(
        F.col("question"), F.coalesce("has_ref", F.lit(False)), F.coalesce("n_pages", F.lit(0)),
        F.coalesce("share", F.lit(0.0)), F.col("coverage"), F.col("score"), vocabulary).alias("broad"))


def with_limits(questions: DataFrame) -> DataFrame:
    """Result sizes: asked for in the words, else asked for in the request, else three; 0 is not a size."""
    q = F.col("question")
    in_words = F.nullif(T.pages_asked(q), F.lit(0))

    def asked(name):
        return F.nullif(name, F.lit(0)) if name in questions.columns else F.lit(None).cast("int")

    pages = F.coalesce(in_words, asked("max_pages"), F.lit(DEFAULT_PAGES))
    images = F.coalesce(F.nullif(T.images_asked(q), F.lit(0)), asked("max_images"), F.lit(DEFAULT_IMAGES))
    return questions.select("qid", T.strip(q).alias("question"), T.clamp(pages, 1, 20).alias("max_pages"),
                            T.clamp(images, 1, 40).alias("max_images"),
                            T.clamp(F.coalesce(in_words, F.lit(PATTERN_SHOWN)), 1, PATTERN_MAX).alias("max_refs"))


def _ranked(questions: DataFrame, catalogue: Catalogue, query_vectors: DataFrame | None) -> DataFrame:
    """Ranked pages; one search per distinct result size (at most nine)."""
    sized = questions.withColumn("size", F.greatest("max_pages", F.lit(MIN_RANKED)))
    sizes = [r["size"] for r in sized.select("size").distinct().collect()]
    found = None
    for size in sorted(sizes):
        hits = rank.search_pages(
            catalogue.pages, sized.filter(F.col("size") == size).select("qid", "question"), catalogue.vocabulary,
            size, catalogue.figures, catalogue.page_vectors if query_vectors is not None else None, query_vectors,
            catalogue.page_index, catalogue.vector_index)
        found = hits if found is None else found.unionByName(hits)
    return stage(found, "ranked")


def merge_ref_pages(ranked: DataFrame, ref_pages: DataFrame, exact: DataFrame, limits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shown pages, ranked pages) once exact references are taken into account.

    Pages naming the reference come first; a reference no page names leaves no
    pages at all, since other pages would only look like evidence.
    """
    named = exact.select("qid").distinct()
    with_pages = ref_pages.select("qid").distinct()
    others = ranked.join(named.join(with_pages, "qid", "left_anti"), "qid", "left_anti").join(limits, "qid")
    first = ref_pages.join(limits, "qid")
    shared = [c for c in ranked.columns if c in ref_pages.columns]
    shown_first = others.filter(F.col("rank") <= F.col("max_pages"))

    def merged(rest):
        both = priority_union(first.select(*shared), rest.select(*shared), keys=["qid", "page_id"], order="rank")
        return top_per_key(both.withColumnRenamed("rank", "position"), ["qid"],
                           [F.asc("stage"), F.asc("position")]).drop("stage", "position")

    shown = merged(shown_first).join(limits, "qid").filter(F.col("rank") <= F.col("max_pages")).drop(
        "max_pages", "max_images", "max_refs", "question")
    return shown, merged(others)


# ---------------------------------------------------------------------- answer texts
# fixed values: wording of the assembled answers
_NO_HIT = ("I could not find anything matching that in the indexed catalogues. "
           "Try a part reference or name the system{}.")
_OFFLINE = ("_The local AI model is offline, so this is the raw catalogue evidence "
            "rather than a written answer._")


def evidence_answer(parts: Column, pages: Column, systems: str = "") -> Column:
    """Readable answer assembled from part and page structs."""
    def part_line(p):
        described = F.when(p["designation"] == "", F.lit("no description recorded in the workbook")).otherwise(p["designation"])
        pictured = F.when(p["photo"].isNotNull(), F.lit(" · reference photo shown below")).otherwise(F.lit(""))
        return F.concat(F.lit("- **"), p["ref"], F.lit("** — "), described, F.lit(" ("), p["kind"], F.lit(")"), pictured)

    def page_line(p):
        excerpt = F.substring(F.regexp_replace(p["snippet"], r"\s+", " "), 1, EVIDENCE_CHARS)
        return F.concat(F.lit("- "), p["system"], F.lit(" · "), T.base_name(p["filename"]), F.lit(" p."),
                        p["page_num"].cast("string"), F.lit(" ("), p["doc_kind"], F.lit(") — "), excerpt)

    none = F.array().cast("array<string>")
    alone = F.when((F.size(parts) == 1) & (F.size(pages) == 0), F.array(F.lit(""), F.concat(
        F.lit("No page in the indexed catalogues mentions **"), F.try_element_at(parts, F.lit(1))["ref"],
        F.lit("**, so the reference data above is everything on file for it.")))).otherwise(none)
    part_lines = F.when(F.size(parts) > 0, F.concat(
        F.array(F.lit("**Matching references**")), F.transform(F.slice(parts, 1, EVIDENCE_ITEMS), part_line), alone,
        F.array(F.lit("")))).otherwise(none)
    page_lines = F.when(F.size(pages) > 0, F.concat(
        F.array(F.lit("**Where this is documented**")),
        F.transform(F.slice(pages, 1, EVIDENCE_ITEMS), page_line))).otherwise(none)
    text = F.array_join(F.concat(part_lines, page_lines, F.array(F.lit(""), F.lit(_OFFLINE))), "\n")
    return F.when((F.size(parts) == 0) & (F.size(pages) == 0), F.lit(_NO_HIT.format(systems))).otherwise(text)


def bundle_text(question: Column, answer: Column, parts: Column, pages: Column, title: str = "Catalogue") -> Column:
    """Plain-text record of one answer: the text, its parts and its source pages."""
    def section(head, items, line):
        return F.when(F.size(items) > 0, F.concat(
            F.array(F.lit(head), F.lit("-" * 20)), F.transform(items, line), F.array(F.lit("")))).otherwise(
            F.array().cast("array<string>"))

    def part_line(p):
        return F.concat(F.lit("  "), p["ref"], F.lit(" ("), p["kind"], F.lit(") — "),
                        F.when(p["designation"] == "", F.lit("no description on file")).otherwise(p["designation"]))

    def page_line(p):
        return F.concat(F.lit("  "), p["system"], F.lit(" · "), T.base_name(p["filename"]), F.lit(" · p."),
                        p["page_num"].cast("string"), F.lit(" ("), p["doc_kind"], F.lit(")"))

    body = F.when(F.coalesce(answer, F.lit("")) != "", F.array(T.strip(answer), F.lit(""))).otherwise(
        F.array().cast("array<string>"))
    head = F.array(F.concat(F.lit(f"{title} — "), question), F.lit("=" * 60), F.lit(""))
    return F.array_join(F.concat(head, body, section("PARTS & ACCESSORIES", parts, part_line),
                                 section("SOURCE PAGES", pages, page_line)), "\n")


# ------------------------------------------------------------------------- the plan
def _gather(rows: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """``qid, name[]``: a few ranked rows per question as an ordered array."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", *columns)))
    return rows.groupBy("qid").agg(ordered.alias(name))


_PART_FIELDS = ["ref", "kind", "designation", "supplier_ref", "photo"]
_PAGE_FIELDS = ["page_id", "doc_id", "filename", "title", "system", "doc_kind", "page_num", "snippet", "score",
                "page_image"]
_FIGURE_FIELDS = ["page_id", "url", "thumb_url", "kind"]


def answer_questions(catalogue: Catalogue, questions: DataFrame, query_vectors: DataFrame | None = None) -> DataFrame:
    """One row per question: ``question, route, answer, terms, pages, images, parts, suggestions, signature``.

    ``route`` says how it was answered: greeting, out_of_scope, pattern, near_miss,
    not_found, broad or evidence.  ``questions`` has ``qid, question`` and may have
    ``max_pages`` and ``max_images``; blank questions are left out.  ``signature`` names the pages behind an
    ``evidence`` answer.
    """
    catalogue = replace(catalogue, page_index=catalogue.page_index or rank.page_index(catalogue.pages),
                        part_index=catalogue.part_index or P.part_index(catalogue.parts))
    vocabulary, parts, photos = catalogue.vocabulary, catalogue.parts, catalogue.ref_images
    asked = with_limits(questions).filter(F.col("question") != "")
    q = F.col("question")
    talk = asked.withColumn("route", F.when(T.is_greeting(q), F.lit("greeting")).when(
        T.is_out_of_scope(q, vocabulary), F.lit("out_of_scope")))
    open_questions = talk.filter("route is null").drop("route")

    patterns = stage(P.read_patterns(open_questions, parts, photos, vocabulary), "patterns")
    found, totals = P.refs_matching(patterns, parts, photos, PATTERN_MAX)
    found = found.join(asked.select("qid", "max_refs"), "qid").filter(F.col("rank") <= F.col("max_refs"))
    listed = stage(_gather(found, "parts", _PART_FIELDS), "pattern_parts")
    pattern_rows = patterns.join(totals, "qid").join(listed, "qid", "left").join(asked.select("qid", "question"), "qid").select(
        "qid", "question", F.lit("pattern").alias("route"), R.describe_pattern(
            F.col("mode"), F.col("value"), F.col("kinds"), F.col("total"),
            F.coalesce(F.size("parts"), F.lit(0))).alias("answer"), F.array("value").alias("terms"), "parts")

    searched = open_questions.join(patterns.select("qid"), "qid", "left_anti")
    searched = stage(searched, "searched")
    limits = searched.select("qid", "max_pages", "max_images", "max_refs")
    ranked = _ranked(searched, catalogue, query_vectors)
    exact_refs = stage(P.refs_in_question(searched, parts, photos), "exact")
    known = P.known_refs(parts, photos)
    exact = stage(exact_refs.join(P.lookup_parts(exact_refs, parts, photos), "ref_norm").withColumn(
        "rank", F.lit(1)), "exact_parts")
    on_pages = P.pages_using_ref(exact.select("qid", "ref", "ref_norm"), catalogue.pages, known, vocabulary, 20,
                                 catalogue.ref_pages) \
        .join(limits.select("qid", F.col("max_pages").alias("page_limit")), "qid").filter(F.col("rank") <= F.col("page_limit"))
    on_pages = stage(on_pages.select(
        "qid", "rank", "page_id", "doc_id", "filename", "title", "system", "systems", "doc_kind", "page_num",
        F.lit(1.0).alias("raw_score"), F.lit(1.0).alias("coverage"), "snippet", F.lit(100).alias("score"),
        T.page_image(F.col("filename"), F.col("page_num")).alias("page_image")), "ref_pages")
    shown, ranked = merge_ref_pages(ranked, on_pages, exact, limits)
    shown, ranked = stage(shown, "shown"), stage(ranked, "merged")

    subject = P.find_parts(searched.join(exact.select("qid"), "qid", "left_anti"), parts, photos, vocabulary, PARTS_SHOWN,
                           catalogue.part_index)
    part_rows = stage(exact.select("qid", "rank", *_PART_FIELDS).unionByName(
        subject.select("qid", "rank", *_PART_FIELDS)), "parts")
    doubtful = searched.filter(T.is_reference_query(q)).join(exact.select("qid"), "qid", "left_anti")
    near = stage(P.near_misses(doubtful.select("qid", R.norm_ref(q).alias("key")), parts, photos, NEAR_SHOWN), "near")

    base = T.content_tokens(q)
    terms = searched.join(exact.select("qid", "ref", "designation"), "qid", "left").select(
        "qid", T.highlight_terms(base, T.expand(base, vocabulary), F.col("ref"), F.col("designation")).alias("terms"))
    figure_pages = ranked.join(limits, "qid").filter(F.col("rank") <= F.greatest("max_pages", F.lit(MIN_FIGURE_PAGES)))
    images = G.figures_for_pages(figure_pages.select("qid", "page_id", "rank"), catalogue.figures, 40) \
        .join(limits.select("qid", "max_images"), "qid").filter(F.col("rank") <= F.col("max_images"))

    heads = facets.topics(ranked, catalogue.pages, vocabulary)
    offered = facets.suggestions(searched, facets.component_families(searched, parts, vocabulary, index=catalogue.part_index), heads,
                                 facets.page_facets(ranked), vocabulary)
    broad = broad_questions(searched, shown, catalogue)

    near_refs = near.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ref"))),
                                                    lambda s: s["ref"]).alias("near_refs"))
    rows = (searched.join(_gather(shown, "pages", _PAGE_FIELDS), "qid", "left")
            .join(_gather(images, "images", _FIGURE_FIELDS), "qid", "left")
            .join(_gather(part_rows, "parts", _PART_FIELDS), "qid", "left")
            .join(_gather(near, "near_parts", _PART_FIELDS), "qid", "left")
            .join(offered.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "suggestion"))),
                                                         lambda s: s["suggestion"]).alias("offers")), "qid", "left")
            .join(terms, "qid").join(broad, "qid").join(near_refs, "qid", "left")
            .join(exact.select("qid", F.lit(True).alias("has_exact")), "qid", "left")
            .join(rank.signature(shown), "qid", "left"))
    rows = rows.withColumn("parts", F.coalesce("parts", F.array().cast(dict(rows.dtypes)["parts"]))).withColumn(
        "pages", F.coalesce("pages", F.array().cast(dict(rows.dtypes)["pages"])))
    as_typed = F.upper(q)
    unanswered = T.is_reference_query(q) & F.col("has_exact").isNull()
    route = (F.when(unanswered & F.col("near_refs").isNotNull(), F.lit("near_miss"))
             .when(unanswered & (F.size("pages") == 0), F.lit("not_found"))
             .when(F.col("broad"), F.lit("broad")).otherwise(F.lit("evidence")))
    rows = rows.withColumn("route", route)
    is_near, is_broad = F.col("route") == "near_miss", F.col("route") == "broad"
    silent = F.col("route").isin("near_miss", "not_found")
    answer = (F.when(is_near, F.concat(
        F.lit("No reference is filed as exactly **"), as_typed, F.lit("**. "),
        F.when(F.size("near_refs") == 1, F.lit("This is the closest one")).otherwise(F.lit("These start with it")), F.lit(":")))
        .when(F.col("route") == "not_found", F.concat(
            F.lit("Nothing in the indexed catalogues or the parts workbook mentions **"), q,
            F.lit("**. Check the reference, or search by what the part does.")))
        .when(is_broad, F.concat(F.lit("“"), q, F.lit("” covers a lot of ground in these catalogues. Pick one to narrow it down:")))
        .otherwise(evidence_answer(F.col("parts"), F.col("pages"))))
    answered = rows.select(
        "qid", "question", "route", answer.alias("answer"),
        F.when(is_near, F.concat(F.array(as_typed), F.col("near_refs"))).otherwise(F.col("terms")).alias("terms"),
        F.when(~silent, F.col("pages")).alias("pages"), F.when(~silent, F.col("images")).alias("images"),
        F.when(is_near, F.col("near_parts")).when(F.col("route") != "not_found", F.col("parts")).alias("parts"),
        F.when(is_near, F.col("near_refs")).when(is_broad, F.col("offers")).alias("suggestions"),
        F.when(F.col("route") == "evidence", F.col("signature")).alias("signature"))
    small_talk = talk.filter("route is not null").select(
        "qid", "question", "route", F.when(F.col("route") == "greeting", F.lit(
            "Hello! I answer questions about the catalogues on file. You can ask me in English or French. "
            "Try a part reference, a component, or a fabrication question:")).otherwise(F.lit(
                "This assistant only answers questions about the catalogues: profiles, accessories, systems and "
                "technical data.")).alias("answer"), F.array().cast("array<string>").alias("terms"),
        F.when(F.col("route") == "greeting", F.array(*[F.lit(p) for p in vocabulary.prompts]).cast("array<string>"))
        .alias("suggestions"))
    return (answered.unionByName(pattern_rows, allowMissingColumns=True)
            .unionByName(small_talk, allowMissingColumns=True))


def answer_with_store(catalogue: Catalogue, questions: DataFrame, path: str, size: int = answer_store.SIZE,
                      query_vectors: DataFrame | None = None) -> DataFrame:
    """:func:`answer_questions` with ``from_cache``: a question that met the same pages before gets the stored answer."""
    answered = stage(answer_questions(catalogue, questions, query_vectors), "answered")
    return answer_store.answered_before(questions.sparkSession, path, answered, size)
