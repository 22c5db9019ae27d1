"""Vectors, bit hashes and boxes as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

PHASH_BITS, DHASH_BITS = 64, 256
# fixed values: weights of the blended image similarity and match thresholds
PHASH_WEIGHT, DHASH_WEIGHT, EDGE_WEIGHT = 0.20, 0.25, 0.55
HASH_MATCH, REGION_MATCH, MIN_INLIERS = 0.85, 0.55, 15
MISSING_DISTANCE = 999
MARK_OVERLAP = 0.5


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; equals cosine on unit vectors."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def clip01(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))


def percent(share: Column) -> Column:
    """0..100, rounded half to even."""
    return F.bround(F.lit(100.0) * clip01(share), 0).cast("int")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit words; 999 when either is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(MISSING_DISTANCE))


def hamming_words(a: Column, b: Column) -> Column:
    """Differing bits of two hashes stored as equal-length arrays of 64-bit words."""
    per_word = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.coalesce(F.aggregate(per_word, F.lit(0), lambda acc, n: acc + n),
                      F.lit(MISSING_DISTANCE))


def hash_similarity(distance: Column, bits: int) -> Column:
    """1 for equal hashes, 0 for a full-width distance or a missing hash."""
    return F.lit(1.0) - F.least(distance, F.lit(bits)).cast("double") / F.lit(float(bits))


def image_blend(phash_distance: Column, dhash_distance: Column, edge_dot: Column,
                dhash_bits: int = DHASH_BITS) -> Column:
    return (F.lit(PHASH_WEIGHT) * hash_similarity(phash_distance, PHASH_BITS)
            + F.lit(DHASH_WEIGHT) * hash_similarity(dhash_distance, dhash_bits)
            + F.lit(EDGE_WEIGHT) * F.coalesce(clip01(edge_dot), F.lit(0.0)))


def bits_to_long(bits: Column) -> Column:
    """Up to 64 booleans -> LONG, first bit lowest."""
    flagged = F.transform(bits, lambda b, i: F.when(
        b, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(flagged, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x))


# ----------------------------------------------------------------------- boxes
def page_fraction(value: Column, origin: Column, extent: Column) -> Column:
    return F.round((value - origin) / F.when(extent == 0, F.lit(1.0)).otherwise(extent), 5)


def mark_in_crop(mark: Column, crop: Column, min_overlap: float = MARK_OVERLAP) -> Column:
    """Mark ``(x,y,w,h)`` re-expressed inside crop ``(x0,y0,x1,y1)``.

    Null when less than ``min_overlap`` of the mark lies inside the crop.
    """
    right, bottom = mark["x"] + mark["w"], mark["y"] + mark["h"]
    left, top = F.greatest(mark["x"], crop["x0"]), F.greatest(mark["y"], crop["y0"])
    x1, y1 = F.least(right, crop["x1"]), F.least(bottom, crop["y1"])
    width, height = crop["x1"] - crop["x0"], crop["y1"] - crop["y0"]
    area = (right - mark["x"]) * (bottom - mark["y"])
    area = F.when(area == 0, F.lit(1e-9)).otherwise(area)
    inside = ((width > 0) & (height > 0) & (x1 > left) & (y1 > top)
              & ((x1 - left) * (y1 - top) / area >= min_overlap))
    return F.when(inside, F.struct(
        F.round((left - crop["x0"]) / width, 5).alias("x"),
        F.round((top - crop["y0"]) / height, 5).alias("y"),
        F.round((x1 - left) / width, 5).alias("w"),
        F.round((y1 - top) / height, 5).alias("h")))


def quad_to_box(xs: Column, ys: Column, width: Column, height: Column) -> Column:
    """Corner coordinates -> clipped page-fraction box, null when empty."""
    x0, x1 = F.greatest(F.array_min(xs), F.lit(0.0)), F.least(F.array_max(xs), width)
    y0, y1 = F.greatest(F.array_min(ys), F.lit(0.0)), F.least(F.array_max(ys), height)
    return F.when((width > 0) & (height > 0) & (x1 > x0) & (y1 > y0), F.struct(
        F.round(x0 / width, 5).alias("x"), F.round(y0 / height, 5).alias("y"),
        F.round((x1 - x0) / width, 5).alias("w"), F.round((y1 - y0) / height, 5).alias("h")))
