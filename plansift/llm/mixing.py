"""Mixing of sources to target weights: budgets go down a tree, documents are a token-prefix of seeded epochs.

DataFrame functions only.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plansift.llm.base import WORD_PATTERN, table
from plansift.staging import stage

#: Steps of eight bits by which the order value of a leaf's last document is narrowed down.
STEPS, BITS = 3, 8
NONE = "\u0000none"


def _weight(level: str, weights: Mapping[str, float]) -> Column:
    """Weight of the value in column ``level``; values not listed weigh 1."""
    choice = F.lit(1.0)
    for value, weight in weights.items():
        choice = F.when(F.col(level) == value, F.lit(float(weight))).otherwise(choice)
    return choice


def leaf_budgets(supply: DataFrame, levels: list[str], weights: Mapping[str, Mapping[str, float]], budget: Column | float,
                 epochs: int) -> DataFrame:
    """(levels..., tokens, granted): the budget of each leaf of the tree, at most ``epochs`` times its tokens.

    At each node the budget is divided among the children by weight; what a
    child cannot take (its whole subtree times ``epochs``) goes to its
    siblings, again by weight.  A shortage below a child is thus shared inside
    it first and reaches its siblings only when the child is exhausted.  The
    children that are filled are those with the least room per weight, found
    by running sums over a node's children.
    """
    now = supply.agg(F.lit(budget if isinstance(budget, Column) else float(budget)).alias("granted"))
    for depth, level in enumerate(levels):
        path, parent = levels[:depth + 1], levels[:depth]
        children = supply.groupBy(*path).agg((F.sum("tokens") * epochs).cast("double").alias("room"))
        children = children.withColumn("w", _weight(level, weights.get(level, {})))
        now = children.join(now, parent) if parent else children.join(F.broadcast(now))  # the root: one row
        by = W.partitionBy(*[F.col(c) for c in parent]) if parent else W.partitionBy(F.lit(0))
        by_need = by.orderBy(F.when(F.col("w") > 0, F.col("room") / F.col("w")).otherwise(F.lit(float("inf"))), F.col(level))
        before = by_need.rowsBetween(W.unboundedPreceding, -1)
        now = (now.withColumn("filled", F.coalesce(F.sum("room").over(before), F.lit(0.0)))
               .withColumn("open", F.sum("w").over(by_need.rowsBetween(0, W.unboundedFollowing)))
               .withColumn("full", (F.col("w") > 0) & (F.col("filled") + F.col("room") * F.col("open") / F.col("w") <= F.col("granted")))
               .withColumn("left", F.col("granted") - F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(by), F.lit(0.0)))
               .withColumn("share", F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(by), F.lit(0.0)))
               .select(*path, F.when(F.col("full"), F.col("room"))
                       .when(F.col("w") > 0, F.col("left") * F.col("w") / F.col("share")).otherwise(0.0).alias("granted")))
        now = stage(now, "budgets")
    return supply.join(now, levels).select(*levels, "tokens", "granted")


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, float]], share: float = 1.0,
        epochs: int = 2, seed: int = 42, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that the mixture takes, with ``mix_levels`` (array), ``mix_tokens``, ``mix_epoch``.

    ``share``: budget as a share of the corpus's words.  A leaf takes whole
    epochs, then of the next one the documents in the order of a seeded hash
    of key and text, as long as the running sum of words stays within its
    budget.  A document taken in several epochs comes as several rows.  Null
    levels are a value of their own; null texts have no words and go with any
    prefix they fall into; rows repeated with key and text are taken together.
    A node whose children all weigh 0 takes nothing.

    Counts cover all documents.  Texts are read twice and never shuffled
    unless the table of leaves outgrows Spark's broadcast threshold.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    names = [f"l{i}" for i in range(len(levels))]
    body = F.coalesce(F.col(text), F.lit(""))
    full = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()],
                       *[F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in zip(names, levels.values())],
                       F.regexp_count(body, F.lit(WORD_PATTERN)).cast("long").alias("tokens"),
                       F.xxhash64(F.col(key), body).alias("id"))
    light = stage(full.select(*names, "tokens", "id"), "light")
    supply = stage(light.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "supply")
    total = supply.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()[0]
    by_name = {n: weights.get(level, {}) for n, level in zip(names, levels)}
    plan = leaf_budgets(supply, names, by_name, float(total) * share, epochs)
    whole = F.when(F.col("tokens") > 0, F.least(F.floor(F.col("granted") / F.col("tokens") + 1e-12), F.lit(epochs))).otherwise(0)
    plan = plan.withColumn("whole", whole.cast("int"))
    room = F.floor(F.col("granted") - F.col("whole") * F.col("tokens") + 1e-6).cast("long")
    plan = stage(plan.select(*names, "whole", room.alias("room"), F.lit(0).cast("long").alias("prefix")), "plan")
    order = F.xxhash64(F.col("id"), F.lit(seed), F.col("whole"))

    # the leaf's cut: bits of the order value narrowed down step by step, then the rows left; order as signed longs
    for step in range(1, STEPS + 1):
        rest = 64 - BITS * step
        rows = light.join(plan, names).withColumn("b", F.shiftright(order, rest))
        if step > 1:
            rows = rows.filter(F.shiftright("b", BITS) == F.col("prefix"))
        sums = rows.groupBy(*names, "b").agg(F.sum("tokens").alias("t"), F.first("room").alias("room"))
        upto = W.partitionBy(*[F.col(n) for n in names]).orderBy("b")
        sums = sums.withColumn("end", F.sum("t").over(upto))
        cut = sums.filter("end > room").groupBy(*names).agg(F.min("b").alias("b"), F.min(F.col("end") - F.col("t")).alias("start"))
        past = F.lit((1 << (BITS * step - 1)))  # no value reaches it: everything goes
        plan = stage(plan.join(cut, names, "left").select(
            *names, "whole", (F.col("room") - F.coalesce("start", F.lit(0))).alias("room"),
            F.coalesce("b", past).alias("prefix")), "plan")
    rest = 64 - BITS * STEPS
    rows = light.join(plan, names).withColumn("h", order).filter(F.shiftright("h", rest) == F.col("prefix"))
    upto = W.partitionBy(*[F.col(n) for n in names]).orderBy("h").rangeBetween(W.unboundedPreceding, 0)
    last = rows.withColumn("end", F.sum("tokens").over(upto)).filter("end <= room").groupBy(*names).agg(F.max("h").alias("last"))
    plan = stage(plan.join(last, names, "left").select(*names, "whole", "prefix", "last"), "plan")

    taken = F.col("whole") + F.when((F.shiftright(order, rest) < F.col("prefix"))
                                    | F.coalesce((F.shiftright(order, rest) == F.col("prefix")) & (order <= F.col("last")),
                                                 F.lit(False)), 1).otherwise(0)
    chosen = full.join(plan, names).withColumn("n", taken).filter("n > 0")
    chosen = chosen.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return chosen.select(*[F.col(a).alias(c) for c, a in own.items()], F.array(*names).alias("mix_levels"),
                         F.col("tokens").alias("mix_tokens"), F.col("epoch").cast("long").alias("mix_epoch"))


#: Settings of the query and of the pipeline: sources fall into four domains by their number.
WEIGHTS = {"domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}, "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0}}


def default_levels() -> dict[str, Column]:
    number = F.regexp_extract(F.col("source"), "([0-9]{1,9})", 1)
    domain = F.concat(F.lit("d"), F.when(number != "", number.cast("long") % 4).otherwise(F.lit(0)).cast("string"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op6_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mix(docs, default_levels(), WEIGHTS, share=0.8)
    return mixed.select("doc_id", F.col("mix_levels")[0].alias("domain"), "lang", "source",
                        F.col("mix_tokens").alias("tokens"), F.col("mix_epoch").alias("epoch"))
