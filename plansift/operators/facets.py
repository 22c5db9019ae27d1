"""Narrowing a broad question: headings, part families, suggestions, autocomplete."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plansift import vocab as V
from plansift.functions import text as T
from plansift.operators import fts
from plansift.operators.relational import (BROADCAST_ROWS, bag_counts, broadcast_within, explode_once, keep_first,
                                           rows_up_to, top_per_key)
from plansift.operators.parts import part_index
from plansift.sources import text_index
from plansift.vocab import Vocabulary

FACET_PAGES, FACET_LIMIT = 24, 10
SUGGESTIONS = 6


def heading_rows(pages: DataFrame, keys: list[str], vocabulary: Vocabulary) -> DataFrame:
    """``*keys, heading``: every capital-letter section heading of the pages.

    Lines are filtered inside the array, so only headings become rows.
    """
    tidy = F.transform(T.lines(F.col("text")), T.heading_line)
    heads = F.filter(tidy, lambda line: T.is_heading(line, vocabulary))
    return explode_once(pages, keys, F.transform(heads, T.title_case), "heading")


def topics(ranked: DataFrame, pages: DataFrame, vocabulary: Vocabulary, limit: int = FACET_LIMIT) -> DataFrame:
    """``qid, heading, n, rank``: most frequent headings of the first 24 ranked pages."""
    first = ranked.filter(F.col("rank") <= FACET_PAGES).select("qid", "page_id")
    first = broadcast_within(first, rows_up_to(first, BROADCAST_ROWS))
    rows = heading_rows(pages.select("page_id", "text").join(first, "page_id"), ["qid"], vocabulary)
    return bag_counts(rows, ["qid"], "heading", limit)


def asked_part_kind(content: Column) -> Column:
    """First kind of part a question names, or null."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for kind, words in V.FACET_KIND_WORDS.items():
        chain = chain.when(T.has_any(content, words), F.lit(kind))
    return chain


def component_families(questions: DataFrame, parts: DataFrame, vocabulary: Vocabulary,
                       limit: int = FACET_LIMIT, index: text_index.TextIndex | None = None) -> DataFrame:
    """``qid, family, n, rank``: part families behind a question, singletons dropped.

    A named kind takes that whole kind; other questions take the parts their words
    or synonyms match, all of them.
    """
    def grouped(rows, key):
        """``key, family, n``; equal designations are counted before their family is worked out."""
        named = rows.groupBy(key, "designation").agg(F.count(F.lit(1)).alias("n"))
        return (named.select(key, T.designation_group(F.col("designation")).alias("family"), "n")
                .filter(F.col("family") != "").groupBy(key, "family").agg(F.sum("n").alias("n")))

    asked = questions.select("qid", F.array_distinct(T.content_tokens(F.col("question"))).alias("base"))
    asked = asked.withColumn("kind", asked_part_kind(F.col("base")))
    kinds = asked.filter("kind is not null").select("qid", "kind")
    # counted per kind before it meets the questions
    per_kind = grouped(parts.filter(F.length("designation") > 2), "kind")
    by_kind = per_kind.join(broadcast_within(kinds, rows_up_to(kinds, BROADCAST_ROWS)), "kind") \
        .select("qid", "family", "n")
    worded = asked.filter("kind is null and size(base) > 0").withColumn(
        "expanded", T.expand(F.col("base"), vocabulary))
    matched = text_index.matching(index or part_index(parts), "part_id", fts.phrase_rows(worded))
    by_words = grouped(parts.join(matched, "part_id"), "qid")
    ranked = top_per_key(by_kind.unionByName(by_words), ["qid"], [F.desc("n"), F.asc("family")], limit)
    return ranked.filter("n > 1")


def page_facets(ranked: DataFrame) -> DataFrame:
    """``qid, systems[], doc_kinds[]`` of the first 24 ranked pages."""
    first = ranked.filter(F.col("rank") <= FACET_PAGES)
    return first.groupBy("qid").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("systems")))).alias("systems"),
        F.array_sort(F.collect_set("doc_kind")).alias("doc_kinds"))


def suggestions(questions: DataFrame, components: DataFrame, heads: DataFrame, facets: DataFrame,
                vocabulary: Vocabulary) -> DataFrame:
    """``qid, rank, suggestion``: families, headings, systems, then drawings; six at most."""
    asked = questions.select("qid", T.system_named(F.col("question"), vocabulary).alias("named"))
    suffix = F.coalesce(F.concat(F.lit(" — "), F.col("named")), F.lit(""))
    offered = F.col("suggestion")

    def taken(rows, item, k, stage):
        return rows.filter(F.col("rank") <= k).join(asked, "qid").select(
            "qid", F.lit(stage).alias("stage"), F.col("rank").alias("position"),
            F.concat(F.col(item), suffix).alias("suggestion"))

    systems = facets.join(asked, "qid").select("qid", "named", "systems", "doc_kinds")
    listed = systems.filter("named is null").select(
        "qid", F.posexplode(F.slice("systems", 1, 3)).alias("position", "system")).select(
        "qid", F.lit(2).alias("stage"), "position",
        F.concat(F.lit("What does "), "system", F.lit(" cover?")).alias("suggestion"))
    drawings = systems.filter(F.array_contains("doc_kinds", "fabrication drawing")).select(
        "qid", F.lit(3).alias("stage"), F.lit(0).alias("position"),
        F.concat(F.lit("Fabrication drawings for "),
                 F.coalesce("named", F.try_element_at("systems", F.lit(1)))).alias("suggestion"))
    rows = (taken(components, "family", 4, 0).unionByName(taken(heads, "heading", 3, 1))
            .unionByName(listed).unionByName(drawings).withColumn("key", F.lower(offered)))
    unique = keep_first(rows, ["qid", "key"], [F.col("stage"), F.col("position")])
    return top_per_key(unique, ["qid"], [F.asc("stage"), F.asc("position")], SUGGESTIONS).select(
        "qid", "rank", "suggestion")


def autocomplete(typed: DataFrame, near: DataFrame, found: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``qid, rank, suggestion``: near references, then parts, then matching prompts.

    ``typed`` has ``qid, question``; ``near`` and ``found`` have ``qid, rank, ref``.
    """
    asked = typed.filter(F.length(T.strip(F.col("question"))) >= 2)
    prompts = F.array(*[F.lit(p) for p in vocabulary.prompts]).cast("array<string>")
    needle = F.lower(T.strip(F.col("question")))
    fitting = asked.select("qid", F.posexplode(F.filter(
        prompts, lambda p: F.contains(F.lower(p), needle))).alias("position", "suggestion"))
    rows = (near.select("qid", F.lit(0).alias("stage"), F.col("rank").alias("position"), F.col("ref").alias("suggestion"))
            .unionByName(found.select("qid", F.lit(1).alias("stage"), F.col("rank").alias("position"),
                                      F.col("ref").alias("suggestion")))
            .unionByName(fitting.select("qid", F.lit(2).alias("stage"), "position", "suggestion"))
            .withColumn("key", F.lower("suggestion")))
    unique = keep_first(rows.join(asked.select("qid"), "qid", "left_semi"), ["qid", "key"],
                        [F.col("stage"), F.col("position")])
    return top_per_key(unique, ["qid"], [F.asc("stage"), F.asc("position")], SUGGESTIONS).select(
        "qid", "rank", "suggestion")


def is_broad(question: Column, has_ref: Column, n_pages: Column, share: Column, top_coverage: Column,
             top_score: Column, vocabulary: Vocabulary) -> Column:
    """Should the customer narrow the question down before it is answered?

    ``share`` is the page share of a one-word question's word, ``top_*`` describe
    the best page.  The first condition that applies decides.
    """
    toks = T.tokens(question)
    content = T.drop_stop_words(toks)
    tidy = F.regexp_replace(F.lower(question), r"^[ ?!.,;]+|[ ?!.,;]+$", "")
    synonym_words = sorted(vocabulary.synonyms)
    opener = r"(?s)^(" + "|".join(V.GREETING_OPENERS) + r")\b[^\n]*$"
    single = F.size(content) == 1
    return (F.when(F.size(toks) == 0, True)
            .when(has_ref, False)
            .when(F.size(content) == 0, True)
            .when(T.has_any(content, V.VAGUE_WORDS) & (F.size(content) <= 3), True)
            .when(tidy.rlike(opener), True)
            .when(n_pages == 0, True)
            .when(F.forall(content, lambda t: t.isin(*vocabulary.broad_words)), True)
            .when(single & (share > V.COMMON_TOKEN_SHARE), True)
            .when(T.has_any(content, synonym_words), False)
            .when((top_coverage == 0) & (top_score < 60), True)
            .when(single & T.system_named(question, vocabulary).isNull() & (top_coverage < 1), True)
            .otherwise(False))
