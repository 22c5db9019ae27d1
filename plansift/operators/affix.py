"""References by the letters they start with, end in or contain, met by equality.

Every reference has keys: its prefixes, its suffixes and its runs of up to ``GRAM`` letters.  A
pattern has one key; contained values longer than ``GRAM`` meet by their first run and are then
checked.  The keys are either stored (:func:`affix_index`) or made in the scan, then only of the
lengths that the patterns have, so that rows without a hit are never shuffled; for a few patterns
rows without any of their keys are left out before.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plansift.functions import refs as R
from plansift.staging import pinned

GRAM = 3
#: Patterns that rows are tested for before their keys are made.
FEW_PATTERNS = 64
MODES = {"prefix": "<", "suffix": ">", "contains": "~"}


def _cut(ref: Column, start: Column, length: Column) -> Column:
    return F.substring(ref, start, length)


def affix_keys(ref: Column, prefixes: Column, suffixes: Column, grams: Column) -> Column:
    """Keys of a reference for the given arrays of lengths; lengths beyond the reference give none."""
    def of(lengths, keys):
        return F.flatten(F.transform(F.filter(lengths, lambda n: n <= F.length(ref)), keys))
    starts = of(prefixes, lambda n: F.array(F.concat(F.lit("<"), _cut(ref, F.lit(1), n))))
    ends = of(suffixes, lambda n: F.array(F.concat(F.lit(">"), _cut(ref, F.length(ref) - n + 1, n))))
    inside = of(grams, lambda n: F.transform(F.sequence(F.lit(1), F.length(ref) - n + 1),
                                             lambda i: F.concat(F.lit("~"), _cut(ref, i, n))))
    return F.array_distinct(F.concat(starts, ends, inside))


def affix_index(refs: DataFrame) -> DataFrame:
    """``key, ref_norm``: every key of every reference, to be stored; repeated references once."""
    lengths = F.sequence(F.lit(1), F.greatest(F.length("ref_norm"), F.lit(1)))
    grams = F.sequence(F.lit(1), F.lit(GRAM))
    rows = refs.select("ref_norm").filter(F.length("ref_norm") > 0).distinct()
    return rows.withColumns({"lengths": lengths, "grams": grams}).select(
        F.explode(affix_keys(F.col("ref_norm"), F.col("lengths"), F.col("lengths"), F.col("grams"))).alias("key"), "ref_norm")


def pattern_keys(patterns: DataFrame) -> DataFrame:
    """``patterns`` (``mode, value``) with the ``key`` and the length of it that a reference must have."""
    part = F.when(F.col("mode") == "contains", F.substring("value", 1, GRAM)).otherwise(F.col("value"))
    sign = F.when(F.col("mode") == "prefix", "<").when(F.col("mode") == "suffix", ">").when(F.col("mode") == "contains", "~")
    return patterns.withColumn("key", F.concat(sign, part)).withColumn("key_length", F.length(part)).filter("key is not null")


def may_hit(ref: Column, few: list[tuple[str, str, int]]) -> Column:
    """Does ``ref`` have the key of any of a few patterns (``mode, key, key_length``)?  Compiled tests, no arrays."""
    tests = F.lit(False)
    for mode, n in sorted({(m, n) for m, _, n in few}):
        values = sorted({k[1:] for m, k, length in few if (m, length) == (mode, n)})
        if mode == "contains":
            for value in values:
                tests = tests | ref.contains(value)
        else:
            cut = _cut(ref, F.lit(1) if mode == "prefix" else F.length(ref) - n + 1, F.lit(n))
            tests = tests | ((F.length(ref) >= n) & cut.isin(values))
    return tests


def position_hits(patterns: DataFrame, keyed: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """``qid, asked_kind, *keyed``: rows of ``keyed(ref_norm, ...)`` that satisfy each pattern (``qid, mode, value, kind``).

    ``index`` is a stored :func:`affix_index` over these references.
    """
    asked, few = pinned(pattern_keys(patterns.select("qid", "mode", "value", "kind")), "asked-affixes")
    asked = F.broadcast(asked) if few is not None else asked
    exact = R.matches_position(F.col("ref_norm"), F.col("mode"), F.col("value"))
    columns = ["qid", F.col("asked_kind"), *keyed.columns]
    if index is not None:
        hits = index.join(asked.select("qid", "mode", "value", F.col("kind").alias("asked_kind"), "key"), "key").filter(exact)
        return keyed.join(hits.select("qid", "asked_kind", "ref_norm"), "ref_norm").select(*columns)
    lengths = {}
    for mode in MODES:
        if few is None:
            lengths[mode] = asked.agg(F.array_distinct(F.collect_set(F.when(F.col("mode") == mode, F.col("key_length"))))).scalar()
        else:
            found = sorted({n for m, n in zip(few["mode"].to_pylist(), few["key_length"].to_pylist()) if m == mode})
            lengths[mode] = F.array(*[F.lit(n) for n in found]).cast("array<int>")
    if few is not None and few.num_rows <= FEW_PATTERNS:
        keyed = keyed.filter(may_hit(F.col("ref_norm"), list(zip(*(few[c].to_pylist() for c in ("mode", "key", "key_length"))))))
    rows = keyed.withColumns({f"{mode}_": column for mode, column in lengths.items()})
    keys = affix_keys(F.col("ref_norm"), F.col("prefix_"), F.col("suffix_"), F.col("contains_"))
    rows = rows.select(*keyed.columns, F.explode(keys).alias("affix"))
    hits = rows.join(asked.select("qid", "mode", "value", F.col("kind").alias("asked_kind"), F.col("key").alias("affix")), "affix")
    return hits.filter(exact).select(*columns)
