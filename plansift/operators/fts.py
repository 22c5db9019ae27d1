"""Full-text matching: tokens, postings, question words, weighted BM25.

Scores follow the usual inverted-index formula with column weights inside the
term frequency:

    tf(d,q)  = sum over columns of weight * tokens starting with q
    idf(q)   = ln((N - n + 0.5) / (n + 0.5)), 1e-6 where that is not positive
    score(d) = - sum over q of idf * tf * 2.2 / (tf + 1.2*(0.25 + 0.75*len/avglen))

so a *smaller* (more negative) score is a better match.  The stored index and the search
over it are in ``sources.text_index``.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, functions as F

from plansift.functions import text as T

# fixed values: BM25 parameters, column weights
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
PAGE_WEIGHTS = {"text": 1.0, "refs": 8.0, "title": 3.0, "ocr_text": 1.5}
PART_WEIGHTS = {"ref": 2.0, "designation": 1.0}
SCORE_DIGITS = 9


def column_text(df: DataFrame, name: str) -> Column:
    is_array = df.schema[name].dataType.typeName() == "array"
    return F.array_join(F.col(name), " ") if is_array else T.blank_to_empty(F.col(name))


def column_tokens(df: DataFrame, name: str) -> Column:
    return T.index_tokens(column_text(df, name))


def _count_terms(batches, columns: list[str], key: str):
    """``key, col, term, tf`` from a row a key with the tokens of each column."""
    for batch in batches:
        for i, name in enumerate(columns):
            lists = batch.column(i + 1)
            terms = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(lists)), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
            pairs, tf = np.unique(row * max(len(terms.dictionary), 1) + terms.indices.to_numpy(), return_counts=True)
            row, term = np.divmod(pairs, max(len(terms.dictionary), 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.repeat(name, len(row)), terms.dictionary.take(pa.array(term)), pa.array(tf, pa.int64())],
                names=[key, "col", "term", "tf"])


def postings(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, col, term, tf`` for every column.

    Texts are shuffled whole and their terms are counted where they lie; rows of one key count together.
    """
    names = {name: f"t_{i}" for i, name in enumerate(columns)}
    texts = df.select(key, *[column_text(df, name).alias(to) for name, to in names.items()])
    whole = texts.groupBy(key).agg(*[F.collect_list(to).alias(to) for to in names.values()])
    toks = whole.select(key, *[F.flatten(F.transform(to, T.index_tokens)).alias(to) for to in names.values()])
    kind = df.schema[key].dataType.simpleString()
    return toks.mapInArrow(lambda batches: _count_terms(batches, columns, key), f"`{key}` {kind}, col string, term string, tf long")


def phrase_rows(questions: DataFrame, base: str = "base", expanded: str = "expanded") -> DataFrame:
    """``qid, phrase, n_all, n_any``: how often a phrase counts in each query form.

    ``n_all`` is its multiplicity among the question's own words (the strict
    query), ``n_any`` is 1 for every distinct expanded word (the wide query).
    """
    strict = questions.select("qid", F.explode(base).alias("word"), F.lit(1).alias("n_all"),
                              F.lit(0).alias("n_any"))
    wide = questions.select("qid", F.explode(expanded).alias("word"), F.lit(0).alias("n_all"),
                            F.lit(1).alias("n_any"))
    words = strict.unionByName(wide).withColumn(
        "phrase", F.regexp_replace(T.fold(F.col("word")), r"[^\p{L}\p{N}]+", ""))
    return (words.filter(F.length("phrase") > 0).groupBy("qid", "phrase")
            .agg(F.sum("n_all").alias("n_all"), F.max("n_any").alias("n_any")))


def idf(n_docs: Column, n: Column) -> Column:
    value = F.log((n_docs - n + F.lit(0.5)) / (n + F.lit(0.5)))
    return F.when(value > 0, value).otherwise(F.lit(IDF_FLOOR))


def gain(idf: Column, tf: Column, length: Column, avg_len: Column) -> Column:
    """What one phrase adds; grows with ``tf`` and falls with ``length``."""
    return idf * tf * F.lit(K1 + 1.0) / (tf + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * length / avg_len))


def highest_gain(idf: Column, most: Column, densest: Column, avg_len: Column) -> Column:
    """Bound of :func:`gain` over pages with at most ``most`` as tf and ``densest`` as tf / length."""
    return idf * F.lit(K1 + 1.0) / (F.lit(1.0) + F.lit(K1) * (F.lit(1.0 - B) / most + F.lit(B) / (densest * avg_len)))


def scores(rows: DataFrame, keys: list) -> DataFrame:
    """``*keys, all_score, any_score`` from rows of ``tf, len, idf, avg_len, n_all, n_any, n_needed``.

    ``all_score`` is null unless every word of the question matched; ``any_score``
    is the wide query's score.
    """
    gains = rows.withColumn("gain", gain(F.col("idf"), F.col("tf"), F.col("len"), F.col("avg_len")))
    whole = (F.count_if(F.col("n_all") > 0) == F.max("n_needed")) & (F.max("n_needed") > 0)
    return gains.groupBy(*keys).agg(
        # rounded: the order in which partial sums arrive must not decide ties
        F.when(whole, F.round(-F.sum(F.col("gain") * F.col("n_all")), SCORE_DIGITS)).alias("all_score"),
        F.round(-F.sum(F.col("gain") * F.col("n_any")), SCORE_DIGITS).alias("any_score"))
