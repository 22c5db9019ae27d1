"""Connected components of an edge table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node ``a`` or ``b`` of ``edges`` but the roots; root: the smallest node reachable.

    Large-star and small-star steps take turns until the edges stay the same
    (a logarithmic number of rounds).  Minima are aggregated before the
    shuffle and hubs meet a one-row side in the join, where skew handling can
    split them; no neighbourhood is ever gathered.  Each round is written to
    the shared folder, which ends the lineage.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, seen = stage(pairs, "links"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = stage(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .distinct(), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
