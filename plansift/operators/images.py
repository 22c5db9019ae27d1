"""Finding images: bit hashes, edge histograms, region vectors."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plansift.functions import vectors as X
from plansift.operators.figures import MEDIA_ROOT
from plansift.operators.relational import best_by

PER_LIST_FACTOR = 4
SHORTLIST = 32


def descriptor_similarity(images: DataFrame, query: DataFrame, dhash_bits: int = X.DHASH_BITS) -> DataFrame:
    """Blended similarity of every image with one query image.

    ``images`` and the one-row ``query`` have ``phash LONG, dhash ARRAY<LONG>,
    edge ARRAY<FLOAT>``.  The query enters as scalar values: one projection over
    the image table, no join.
    """
    usable = images.filter(F.col("edge").isNotNull() | F.col("phash").isNotNull())
    rows = usable.withColumns({f"q_{name}": query.select(name).scalar() for name in ("phash", "dhash", "edge")})
    rows = (rows.withColumn("phash_distance", X.hamming(F.col("phash"), F.col("q_phash")))
            .withColumn("dhash_distance", X.hamming_words(F.col("dhash"), F.col("q_dhash")))
            .withColumn("edge_dot", X.dot(F.col("edge"), F.col("q_edge"))))
    return rows.withColumn("similarity", X.image_blend(
        F.col("phash_distance"), F.col("dhash_distance"), F.col("edge_dot"), dhash_bits))


def find_by_hash(figures: DataFrame, photos: DataFrame, query: DataFrame, max_results: int = 8,
                 dhash_bits: int = X.DHASH_BITS, min_similarity: float = X.HASH_MATCH) -> DataFrame:
    """Best images of both libraries: a short list from each, merged and cut.

    Both inputs have ``image_key`` and the descriptor columns.
    """
    def short(images, kind):
        scored = descriptor_similarity(images, query, dhash_bits)
        return scored.orderBy(F.desc("similarity"), F.asc("image_key")).limit(
            max_results * PER_LIST_FACTOR).select(F.lit(kind).alias("kind"), "image_key", "similarity")

    merged = short(figures, "catalogue").unionByName(short(photos, "part"))
    top = merged.orderBy(F.desc("similarity"), F.asc("kind"), F.asc("image_key")).limit(max_results)
    return top.select("kind", "image_key", "similarity", X.percent(F.col("similarity")).alias("percent"),
                      (F.col("similarity") >= min_similarity).alias("match"))


def with_pages(hits: DataFrame, figures: DataFrame, pages: DataFrame) -> DataFrame:
    """Image hits that are figures, with where they stand: kind, url, and document, page and system columns.

    ``hits`` has ``image_key``; a hit without figure or page keeps its row.  Page text is not read.
    """
    drawn = figures.select("image_key", "page_id", "kind", F.concat(F.lit(MEDIA_ROOT), "filename").alias("url"))
    about = pages.select("page_id", "doc_id", "filename", "title", "system", "page_num")
    return hits.join(drawn, "image_key", "left").join(about, "page_id", "left")


def best_regions(regions: DataFrame, windows: DataFrame) -> DataFrame:
    """``image_key, region_no, score``: each image by its single best match of a region and a window.

    The query has at most ten windows; they travel as one array value and are
    compared inside the region's row, so no pair becomes a row.  Every region
    counts: images are reduced to their best one before anything is cut.
    """
    batch = windows.agg(F.collect_list("vec")).scalar()
    scored = regions.withColumn("windows", batch).select(
        "image_key", "region_no", F.array_max(F.transform("windows", lambda w: X.dot(F.col("vec"), w))).alias("score"))
    return best_by(scored.filter(F.col("score").isNotNull()), ["image_key"], "score", "region_no")


def rerank(best: DataFrame, inliers: DataFrame | None = None, max_results: int = 8,
           shortlist: int = SHORTLIST) -> DataFrame:
    """Final order of region matches.

    Without geometry the score decides (match from 0.55).  With ``inliers``
    (``image_key, inliers``) the ``shortlist`` best are ordered by inliers, then score, and
    15 inliers make a match; -1 marks a pair that could not be verified.
    """
    if inliers is None:
        top = best.orderBy(F.desc("score"), F.asc("image_key")).limit(max_results)
        return top.select("image_key", "score", F.lit(-1).alias("inliers"),
                          (F.col("score") >= X.REGION_MATCH).alias("match"))
    short = best.orderBy(F.desc("score"), F.asc("image_key")).limit(shortlist)
    checked = short.join(inliers, "image_key", "left").withColumn("inliers", F.coalesce("inliers", F.lit(-1)))
    ordered = checked.orderBy(F.desc(F.greatest("inliers", F.lit(0))), F.desc("score"), F.asc("image_key"))
    return ordered.limit(max_results).select(
        "image_key", "score", "inliers", (F.col("inliers") >= X.MIN_INLIERS).alias("match"))
