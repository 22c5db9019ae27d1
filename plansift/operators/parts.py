"""Parts: exact and positional reference lookup, relevance search, fuzzy fallback."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from plansift.functions import refs as R, text as T
from plansift.operators import affix, fts
from plansift.operators.relational import (BROADCAST_ROWS, broadcast_within, explode_once, keep_first, priority_union,
                                           rows_of, rows_up_to, small_batches, top_per_key, union_all)
from plansift.sources import text_index
from plansift.staging import pinned, small, stage
from plansift.vocab import Vocabulary

# fixed values: relevance weights and the fuzzy cut-off
SPECIFIC_BONUS, SAME_SYSTEM_BONUS, FUZZY_CUTOFF = 0.5, 1.5, 72.0
RANK_SCALE, BM_SCALE = 10, 0.1
NEAR_FACTOR = 3
SYSTEM_NUMBER = r"(?i)\b(\d{2})\s*TH\b"
PHOTO_ROOT = "/refmedia/"


def first_photo(ref_images: DataFrame) -> DataFrame:
    """``ref_norm, photo``: the photo with the lowest id of every reference."""
    first = ref_images.groupBy("ref_norm").agg(F.min_by("filename", "image_id").alias("filename"))
    return first.select("ref_norm", F.concat(F.lit(PHOTO_ROOT), "filename").alias("photo"))


def with_photo(parts: DataFrame, ref_images: DataFrame, few: bool = False) -> DataFrame:
    """Left lookup of the first photo.

    Where ``few`` parts are expected (a top-k), they are evaluated first and photos are reduced to
    their references before they are grouped: the photo table is read but never shuffled whole.
    """
    if few:
        parts = pinned(parts, "shown-parts")[0]
        ref_images = ref_images.join(small(parts.select("ref_norm").distinct(), "shown-refs"), "ref_norm", "left_semi")
    return parts.join(first_photo(ref_images), "ref_norm", "left")


def first_listing(parts: DataFrame) -> DataFrame:
    """One row per reference: the listing with the lowest id."""
    return keep_first(parts, ["ref_norm"], [F.col("part_id")])


def known_refs(parts: DataFrame, ref_images: DataFrame) -> DataFrame:
    """``ref_norm``: every reference of the parts list or the photo library."""
    both = parts.select("ref_norm").unionByName(ref_images.select("ref_norm"))
    return both.filter(F.col("ref_norm") != "").distinct()


def photo_only(parts: DataFrame, ref_images: DataFrame) -> DataFrame:
    """First photo row of every reference that has no parts row."""
    rest = ref_images.join(parts.select("ref_norm"), "ref_norm", "left_anti")
    return keep_first(rest.select("image_id", "ref", "ref_norm", "filename"), ["ref_norm"],
                      [F.col("image_id")])


def merged_designation(parts: DataFrame, keys: tuple[str, ...] = ("ref_norm",),
                       preferred: str | None = None) -> DataFrame:
    """``*keys, designation``: the first two different names of a reference.

    Names are equal when their ASCII letters and digits are.  ``preferred`` names a
    boolean column marking the listing to start with; the listing order follows.
    Each name is folded to its first listing before names are gathered, so a
    reference listed countless times gathers only its distinct names.
    """
    place = F.struct((~F.col(preferred)).alias("later") if preferred else F.lit(False).alias("later"), "part_id")
    named = (parts.withColumn("name", T.strip(F.col("designation"))).withColumn("place", place)
             .withColumn("name_key", F.regexp_replace(F.lower("name"), r"[^a-z0-9]", ""))
             .filter(F.col("name_key") != ""))
    distinct = named.groupBy(*keys, "name_key").agg(F.min(F.struct("place", "name")).alias("first"))
    ranked = top_per_key(distinct, keys, [F.asc("first.place")], 2)
    listed = F.array_sort(F.collect_list(F.struct("rank", F.col("first.name").alias("name"))))
    return ranked.groupBy(*keys).agg(
        F.array_join(F.transform(listed, lambda s: s["name"]), " · ").alias("designation"))


def lookup_parts(wanted: DataFrame, parts: DataFrame, ref_images: DataFrame) -> DataFrame:
    """Exact lookup of ``wanted(ref_norm)``: the parts list first, else the photo library."""
    keys = wanted.select("ref_norm").filter(F.col("ref_norm") != "").distinct()
    keys = broadcast_within(keys, rows_up_to(keys, BROADCAST_ROWS))
    listed = first_listing(parts.join(keys, "ref_norm", "left_semi")).select(
        "ref_norm", "ref", "kind", T.blank_to_empty(F.col("designation")).alias("designation"),
        T.blank_to_empty(F.col("supplier_ref")).alias("supplier_ref"))
    photos = ref_images.join(keys, "ref_norm", "left_semi")
    pictured = keep_first(photos.select("ref_norm", "ref", "image_id"), ["ref_norm"], [F.col("image_id")])
    bare = pictured.select("ref_norm", "ref", F.lit("part").alias("kind"), F.lit("").alias("designation"),
                           F.lit("").alias("supplier_ref"))
    both = priority_union(listed, bare, keys=["ref_norm"], order="ref").drop("stage")
    return both.join(first_photo(photos), "ref_norm", "left")


# ------------------------------------------------------------ positional search
def refs_matching(patterns: DataFrame, parts: DataFrame, ref_images: DataFrame, limit: int = 30,
                  index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(matching references per question, totals per question).

    ``patterns`` has ``qid, mode, value, kind``.  A named kind keeps to that kind
    and leaves out photo-only references; otherwise those follow the listed ones.
    ``index`` is a stored affix index over the references of both tables.  Photos are
    reduced to hits before they are grouped.
    """
    listed = affix.position_hits(patterns, parts, index).filter(
        F.col("asked_kind").isNull() | (F.col("asked_kind") == F.col("kind")))
    listed = keep_first(listed.select("qid", "ref_norm", "part_id", "ref", "kind", "supplier_ref"),
                        ["qid", "ref_norm"], [F.col("part_id")])
    pictured = affix.position_hits(patterns.filter(F.col("kind").isNull()), ref_images.select("image_id", "ref", "ref_norm"), index)
    bare = keep_first(pictured.select("qid", "ref_norm", "ref", "image_id"), ["qid", "ref_norm"], [F.col("image_id")])
    bare = bare.join(parts.select("ref_norm"), "ref_norm", "left_anti").withColumn("kind", F.lit("photo only"))
    rows = listed.select("qid", "ref_norm", "ref", "kind", "supplier_ref", F.col("part_id").alias("hit_id"), F.lit(0).alias("stage")) \
        .unionByName(bare.select("qid", "ref_norm", "ref", "kind", F.lit("").alias("supplier_ref"),
                                 F.lit(None).cast("long").alias("hit_id"), F.lit(1).alias("stage")))
    rows = pinned(rows, "matching-refs")[0]
    totals = patterns.select("qid").join(
        rows.groupBy("qid").agg(F.count(F.lit(1)).alias("total")), "qid", "left") \
        .select("qid", F.coalesce("total", F.lit(0)).alias("total"))
    top = top_per_key(rows, ["qid"], [F.asc("stage"), F.length("ref_norm"), F.asc("ref_norm")], limit)
    listings = parts.select("ref_norm", "part_id", "designation").join(
        top.filter("hit_id is not null").select("qid", "ref_norm", "hit_id"), "ref_norm")
    merged = merged_designation(listings.withColumn("hit", F.col("part_id") == F.col("hit_id")), ("qid", "ref_norm"), preferred="hit")
    shown = top.join(merged, ["qid", "ref_norm"], "left").withColumn(
        "designation", F.coalesce("designation", F.lit("")))
    shown = with_photo(shown, ref_images, few=True)
    return shown.select("qid", "rank", "ref", "ref_norm", "kind", "designation", "supplier_ref", "photo"), totals


def near_misses(typed: DataFrame, parts: DataFrame, ref_images: DataFrame, limit: int = 8,
                index: DataFrame | None = None) -> DataFrame:
    """References that start with what was typed (``typed`` has ``qid, key``)."""
    usable = typed.filter((F.length("key") >= 3) & R.has_digit(F.col("key"))).select(
        "qid", F.lit("prefix").alias("mode"), F.col("key").alias("value"), F.lit(None).cast("string").alias("kind"))
    order = [F.length("ref_norm"), F.asc("ref_norm")]
    listed = top_per_key(
        affix.position_hits(usable, parts.select("part_id", "ref_norm", "ref", "kind", "designation", "supplier_ref"), index),
        ["qid"], [*order, F.asc("part_id")], limit * NEAR_FACTOR)
    photos = affix.position_hits(usable, ref_images.select("ref_norm", "ref", "image_id"), index)
    photos = keep_first(photos.select("qid", "ref_norm", "ref", "image_id"), ["qid", "ref_norm"], [F.col("image_id")])
    pictured = top_per_key(photos, ["qid"], order, limit * NEAR_FACTOR)
    fresh = pictured.join(listed.select("qid", "ref_norm").distinct(), ["qid", "ref_norm"], "left_anti")
    rows = listed.select("qid", F.lit(0).alias("stage"), "rank", "ref", "ref_norm", "kind", "designation",
                         "supplier_ref") \
        .unionByName(fresh.select("qid", F.lit(1).alias("stage"), "rank", "ref", "ref_norm",
                                  F.lit("part").alias("kind"), F.lit("").alias("designation"),
                                  F.lit("").alias("supplier_ref")))
    top = top_per_key(rows.withColumnRenamed("rank", "position"), ["qid"],
                      [F.asc("stage"), F.asc("position")], limit)
    return with_photo(top, ref_images, few=True).select("qid", "rank", "ref", "ref_norm", "kind", "designation",
                                                        "supplier_ref", "photo")


def refs_in_question(questions: DataFrame, parts: DataFrame, ref_images: DataFrame) -> DataFrame:
    """``qid, ref_norm, typed``: the longest real reference a question names."""
    found = questions.select("qid", F.posexplode_outer(R.question_ref_candidates(F.col("question")))
                             .alias("position", "typed")).filter("typed is not null")
    # a few candidates per question, needed for the lookup and for the result
    found = stage(found.withColumn("ref_norm", R.norm_ref(F.col("typed"))), "typed_refs")
    wanted = found.select("ref_norm").distinct()
    wanted = broadcast_within(wanted, rows_up_to(wanted, BROADCAST_ROWS))
    existing = known_refs(parts.join(wanted, "ref_norm", "left_semi"),
                          ref_images.join(wanted, "ref_norm", "left_semi"))
    return keep_first(found.join(existing, "ref_norm", "left_semi"), ["qid"], [F.col("position")]) \
        .select("qid", "ref_norm", "typed")


def read_patterns(questions: DataFrame, parts: DataFrame, ref_images: DataFrame,
                  vocabulary: Vocabulary) -> DataFrame:
    """``qid, mode, value, kinds[], kind`` of the questions that ask for a position.

    A fragment without a positional verb only counts while it is not itself a
    reference on file.
    """
    # one row per question that reads as a pattern, needed three times below
    parsed = stage(questions.select("qid", R.ref_pattern(F.col("question"), vocabulary).alias("p")).filter(
        "p is not null").select("qid", "p.*"), "read_patterns")
    doubtful = parsed.filter("implicit").select(F.col("value").alias("ref_norm")).distinct()
    doubtful = broadcast_within(doubtful, rows_up_to(doubtful, BROADCAST_ROWS))
    real = known_refs(parts.join(doubtful, "ref_norm", "left_semi"),
                      ref_images.join(doubtful, "ref_norm", "left_semi"))
    implicit = parsed.filter("implicit").join(real, F.col("value") == F.col("ref_norm"), "left_anti")
    return parsed.filter(~F.col("implicit")).unionByName(implicit).drop("implicit")


# --------------------------------------------------------------- subject search
def relevance(designation: Column, kind: Column, subject: Column, forms: Column,
              asked_system: Column, vocabulary: Vocabulary) -> Column:
    """How well a part row answers the subject of a question; 0 means not at all.

    ``forms[i]`` lists every spelling of ``subject[i]``.  Category words alone are
    no evidence, and another system number rules the row out.
    """
    low = F.lower(F.concat(designation, F.lit(" "), kind))
    hits = F.zip_with(subject, forms, lambda word, spellings: F.when(
        F.exists(spellings, lambda f: F.contains(low, f)),
        F.when(word.isin(*vocabulary.broad_words), 1).otherwise(2)).otherwise(0))
    matched = F.size(F.filter(hits, lambda h: h > 0))
    specific = F.size(F.filter(hits, lambda h: h == 2))
    asked = F.nullif(F.regexp_extract(F.coalesce(asked_system, F.lit("")), SYSTEM_NUMBER, 1), F.lit(""))
    found = F.nullif(F.regexp_extract(designation, SYSTEM_NUMBER, 1), F.lit(""))
    base = matched.cast("double") / F.size(subject) + F.lit(SPECIFIC_BONUS) * specific
    return (F.when((F.trim(designation) == "") | (F.size(subject) == 0) | (specific == 0), F.lit(0.0))
            .when(asked.isNull() | found.isNull(), base)
            .when(asked == found, base + F.lit(SAME_SYSTEM_BONUS)).otherwise(F.lit(0.0)))


def part_subject(questions: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``qid, base, expanded, forms, asked_system`` of the questions with a subject."""
    subject = T.subject_words(T.content_tokens(F.col("question")), vocabulary)
    rows = questions.select("qid", subject.alias("base"),
                            T.system_named(F.col("question"), vocabulary).alias("asked_system"))
    return (rows.filter(F.size("base") > 0)
            .withColumn("expanded", T.expand(F.col("base"), vocabulary))
            .withColumn("forms", F.transform("base", lambda w: T.expand(F.array(w), vocabulary))))


def part_index(parts: DataFrame, path: str | None = None) -> text_index.TextIndex:
    """Full-text index over references and designations."""
    return text_index.build(parts.select("part_id", "ref", "designation"), "part_id", list(fts.PART_WEIGHTS), path)


def relevant_parts(asked: DataFrame, parts: DataFrame, vocabulary: Vocabulary,
                   index: text_index.TextIndex | None = None) -> DataFrame:
    """``qid, part_id, order_key``: all lexical hits that pass the relevance test.

    Rows holding every word are used when there are any, else rows holding any.
    """
    scored = stage(text_index.search(index or part_index(parts), "part_id", fts.PART_WEIGHTS, fts.phrase_rows(asked)), "part-scores")
    strict = scored.filter("all_score is not null").select("qid", "part_id", F.col("all_score").alias("bm"))
    wide = scored.join(strict.select("qid").distinct(), "qid", "left_anti").select("qid", "part_id", F.col("any_score").alias("bm"))
    hits = strict.unionByName(wide)
    rows = parts.join(hits, "part_id").join(asked, "qid")
    rows = rows.withColumn("relevance", relevance(
        T.blank_to_empty(F.col("designation")), T.blank_to_empty(F.col("kind")), F.col("base"), F.col("forms"),
        F.col("asked_system"), vocabulary))
    key = F.lit(RANK_SCALE) * F.col("relevance") - F.col("bm") * F.lit(BM_SCALE)
    return rows.filter(F.col("relevance") > 0).select(
        "qid", "part_id", (-key).alias("order_key"), F.col("bm").alias("position"), "relevance", "bm")


def find_parts(questions: DataFrame, parts: DataFrame, ref_images: DataFrame, vocabulary: Vocabulary,
               limit: int = 6, index: text_index.TextIndex | None = None) -> DataFrame:
    """Parts that answer the subject of each question, best first."""
    asked = part_subject(questions, vocabulary)
    # a few rows per question, needed by the fuzzy pass and by the result
    lexical = stage(relevant_parts(asked, parts, vocabulary, index).select(
        "qid", "part_id", "order_key", "position"), "lexical_parts")
    without = asked.join(lexical.select("qid").distinct(), "qid", "left_anti").filter(
        F.exists("base", lambda w: ~w.isin(*vocabulary.broad_words)))
    needles = without.select("qid", F.array_join("base", " ").alias("needle"))
    fuzzy = fuzzy_parts(needles, parts, limit).select(
        "qid", "part_id", (-F.col("similarity")).alias("order_key"), F.col("rank").cast("double").alias("position"))
    hits = lexical.unionByName(fuzzy)
    rows = parts.join(hits, "part_id").select("qid", "ref_norm", "order_key", "position", "ref", "kind",
                                              "supplier_ref", F.col("part_id").alias("hit_id"))
    unique = keep_first(rows, ["qid", "ref_norm"], [F.col("order_key"), F.col("position"), F.col("hit_id")])
    top = top_per_key(unique, ["qid"], [F.asc("order_key"), F.asc("position"), F.asc("hit_id")], limit)
    listings = parts.select("ref_norm", "part_id", "designation").join(
        top.select("qid", "ref_norm", "hit_id"), "ref_norm").withColumn("hit", F.col("part_id") == F.col("hit_id"))
    merged = merged_designation(listings, ("qid", "ref_norm"), preferred="hit")
    named = top.join(merged, ["qid", "ref_norm"], "left").withColumn(
        "designation", F.coalesce("designation", F.lit("")))
    return with_photo(named, ref_images, few=True).select(
        "qid", "rank", "ref", "ref_norm", "kind", "designation", "supplier_ref", "photo")


# ------------------------------------------------------------------------ fuzzy
def _lcs(a: str, b: str) -> int:
    """Longest common subsequence with one machine-word row per character of ``b``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * _lcs(a, b) / total


def token_set_ratio(a: str, b: str) -> float:
    """0..100 similarity of two word sets.

    The best of three normalised insert/delete ratios between the shared words and
    the shared words plus each side's rest; 100 when one side holds the other.
    """
    words_a, words_b = set(a.split()), set(b.split())
    if not words_a or not words_b:
        return 0.0
    shared = words_a & words_b
    if shared and (shared == words_a or shared == words_b):
        return 100.0
    common = " ".join(sorted(shared))
    left = " ".join(filter(None, [common, *sorted(words_a - shared)]))
    right = " ".join(filter(None, [common, *sorted(words_b - shared)]))
    ratios = [_ratio(left, right)]
    if shared:
        ratios += [_ratio(common, left), _ratio(common, right)]
    return max(ratios)


def _shape(text: Column) -> Column:
    """What bounds a name's similarity: its different words, their joined length, its letters and its two-letter runs,
    each occurrence of these by itself."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")))

    def shape(words):
        joined = F.array_join(words, " ")
        def runs(n):
            starts = F.when(F.length(joined) >= n, F.sequence(F.lit(1), F.length(joined) - (n - 1))).otherwise(F.array().cast("array<int>"))
            return T.let(F.transform(starts, lambda i: F.substring(joined, i, F.lit(n))), lambda all_: F.transform(
                all_, lambda run, i: F.concat(run, F.size(F.filter(F.slice(all_, F.lit(1), i), lambda before: before == run)).cast("string"))))
        return F.struct(words.alias("words"), F.length(joined).alias("size"), runs(1).alias("letters"), runs(2).alias("pairs"))
    return T.let(words, shape)


def may_be_similar(a: Column, b: Column) -> Column:
    """False only where :func:`token_set_ratio` is below the cut-off (``a`` and ``b`` as :func:`_shape` gives them).

    Without a shared word the ratio compares the two joined texts.  Letters kept in order are at most the
    letters in common; and as a letter left out breaks two two-letter runs and one put in breaks one, three times
    the letters kept, less both lengths and one, such runs are in common.  With shared words, the texts compared have the
    same lengths and letters, and the shared words' length against either side counts besides.
    """
    total, shorter = a["size"] + b["size"], F.least(a["size"], b["size"])
    kept = F.lit(FUZZY_CUTOFF / 200) * total
    lengths = shorter >= kept
    letters = F.size(F.array_intersect(a["letters"], b["letters"])) >= kept
    runs = F.size(F.array_intersect(a["pairs"], b["pairs"])) >= 3 * kept - total - 1
    common = F.length(F.array_join(F.array_intersect(a["words"], b["words"]), " "))
    shared = F.lit(200.0) * common >= F.lit(FUZZY_CUTOFF) * (common + shorter)
    return F.when(F.arrays_overlap(a["words"], b["words"]), (lengths & letters) | shared | (common == shorter)).otherwise(
        lengths & letters & runs)


def _similarity(names: pd.Series, needles: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(b, a) for a, b in zip(names, needles)], dtype=float)


def fuzzy_candidates(needles: DataFrame, names: DataFrame) -> DataFrame:
    """``qid, needle, name``: the pairs that bounds do not rule out."""
    shaped = names.withColumn("shape", _shape(F.col("name")))

    def pairs(some):
        batch = some.select(F.struct("qid", "needle", _shape(F.col("needle")).alias("shape")).alias("n")).agg(F.collect_list("n")).scalar()
        rows = shaped.withColumn("batch", batch).withColumn("n", F.explode("batch"))
        return rows.filter(may_be_similar(F.col("shape"), F.col("n.shape"))).select("n.qid", "n.needle", "name")
    return union_all([pairs(some) for some in small_batches(needles, "qid")])


def fuzzy_parts(needles: DataFrame, parts: DataFrame, limit: int = 6) -> DataFrame:
    """``qid, rank, part_id, similarity``: closest names at or above the cut-off.

    ``needles`` (``qid, needle``) are the few questions nothing lexical answered;
    they travel as one array value.  Names are compared once each: equal names
    share one comparison before the rows of that name are ranked.  Pairs that lengths, words or
    two-letter runs rule out never reach Python.
    """
    names = parts.filter(F.length("designation") > 0).select(F.lower("designation").alias("name")).distinct()
    similar = F.pandas_udf(_similarity, "double")
    close = fuzzy_candidates(needles, names).withColumn("similarity", similar("name", "needle")).filter(F.col("similarity") >= FUZZY_CUTOFF)
    rows = parts.withColumn("name", F.lower("designation")).join(small(close.select("qid", "name", "similarity"), "close-names"), "name")
    return top_per_key(rows.select("qid", "part_id", "similarity"), ["qid"],
                       [F.desc("similarity"), F.asc("part_id")], limit)


# -------------------------------------------------------------- references on pages
def refs_in_text(pages: DataFrame, known: DataFrame) -> DataFrame:
    """``page_id, refs[]``: the known references a page names, sorted."""
    found = explode_once(pages, ["page_id"], R.page_ref_candidates(F.col("text")), "ref_norm")
    real = found.join(known, "ref_norm", "left_semi")
    return real.groupBy("page_id").agg(F.array_sort(F.collect_set("ref_norm")).alias("refs"))


def pages_with_refs(pages: DataFrame, known: DataFrame) -> DataFrame:
    """Pages with their ``refs`` filled in (an index-build step)."""
    found = refs_in_text(pages, known).withColumnRenamed("refs", "found_refs")
    return (pages.join(found, "page_id", "left")
            .withColumn("refs", F.coalesce("found_refs", F.array().cast("array<string>"))).drop("found_refs"))


def reference_list(pages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``ref_norm, page_id``: the pages of every known reference, to be stored in this order.

    Pages that carry their references (``known`` is None) are not read for their text.
    """
    if known is None:
        listed = pages.select("page_id", F.explode("refs").alias("ref_norm"))
    else:
        found = explode_once(pages, ["page_id"], R.page_ref_candidates(F.col("text")), "ref_norm")
        listed = found.join(known, "ref_norm", "left_semi")
    rows = listed.select("ref_norm", "page_id").distinct()
    return rows.repartitionByRange("ref_norm", "page_id").sortWithinPartitions("ref_norm", "page_id")


def pages_using_ref(wanted: DataFrame, pages: DataFrame, known: DataFrame, vocabulary: Vocabulary,
                  limit: int = 6, listed: DataFrame | None = None) -> DataFrame:
    """Pages whose text names a reference as a word of its own.

    ``wanted`` has ``qid, ref, ref_norm``.  Every page listing the reference is
    inspected; contents pages go; the first ``limit`` by document and page stay.
    ``listed`` is the stored :func:`reference_list`: with it only the text of the pages
    it names is read.
    """
    wanted, asked = pinned(wanted.filter(F.col("ref_norm") != ""), "wanted-refs")
    wanted = wanted if asked is None else F.broadcast(wanted)
    listed = reference_list(pages, known) if listed is None else rows_of(listed, "ref_norm", asked)
    hits, found = pinned(listed.join(wanted, "ref_norm").select("qid", "page_id", "ref", "ref_norm"), "ref-pages")
    rows = rows_of(pages, "page_id", found).join(hits if found is None else F.broadcast(hits), "page_id")
    body = F.concat("text", F.lit(" "), T.blank_to_empty(F.col("ocr_text")))
    terms = F.array(F.lower("ref_norm"), F.lower("ref"))
    rows = rows.withColumn("body", body).withColumn(
        "snippet", T.snippet(F.coalesce(F.nullif("text", F.lit("")), F.col("ocr_text")), terms))
    low = F.lower("body")
    markers = F.lit(False)
    for marker in vocabulary.contents_markers:
        markers = markers | F.contains(low, F.lit(marker))
    generic = (F.length(T.strip(F.col("snippet"))) < 40) & markers
    divider = (F.length(T.strip(F.col("body"))) < 120) & F.contains(low, F.lit(vocabulary.divider_marker))
    named = F.rlike(F.col("body"), R.standalone(F.col("ref_norm"))) | F.rlike(F.col("body"), R.standalone(F.col("ref")))
    kept = rows.filter(named & ~generic & ~divider)
    return top_per_key(kept, ["qid"], [F.asc("doc_id"), F.asc("page_num"), F.asc("page_id")], limit)
