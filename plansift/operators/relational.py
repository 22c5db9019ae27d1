"""Generic relational building blocks: top-k, first match, budgets, keyed rewrites."""
from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: largest number of rows an operator may pin with a broadcast hint
BROADCAST_ROWS = 1_000_000
#: keys that may reach a scan as literals
LITERAL_KEYS = 1_000
#: rows of a small side that may travel as one array value
BATCH_ROWS = 1_000


def rows_up_to(df: DataFrame, limit: int) -> int | None:
    """Row count of a frame expected to be small, or None when it exceeds ``limit``."""
    n = df.limit(limit + 1).count()
    return n if n <= limit else None


def broadcast_within(df: DataFrame, max_rows: int | None) -> DataFrame:
    """Broadcast hint only where the caller can prove a row bound.

    With no bound (or too large a one) the frame is returned untouched: the
    optimizer then decides from statistics and runtime sizes, with a shuffle join
    as the way that always works.
    """
    return F.broadcast(df) if max_rows is not None and max_rows <= BROADCAST_ROWS else df


def rows_of(df: DataFrame, key: str, wanted: pa.Table | None) -> DataFrame:
    """The rows that can join ``wanted``: where it is a small counted table, its keys reach the scan as a filter.

    A table written in the order of ``key`` then gives up only the row groups and pages that hold them.
    """
    keys = set(wanted[key].to_pylist()) if wanted is not None else set()
    return df.filter(F.col(key).isin(list(keys))) if wanted is not None and len(keys) <= LITERAL_KEYS else df


def small_batches(df: DataFrame, key: str, limit: int = BATCH_ROWS) -> list[DataFrame]:
    """The frame cut into batches of about ``limit`` rows by hash of ``key``.

    For operators that carry their small side (query vectors, patterns, needles) to
    the large one as an array value: an array stays small however many questions
    are asked, at the price of one scan of the large side per batch.
    """
    count = max(1, -(-df.count() // limit))
    if count == 1:
        return [df]
    number = F.pmod(F.xxhash64(key), F.lit(count))
    return [df.filter(number == i) for i in range(count)]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame)
    return merged


def explode_once(df: DataFrame, keep: Sequence[str], array: Column, name: str) -> DataFrame:
    """One row per array element, with the array evaluated once per row.

    A plain ``explode`` makes the optimizer add a size test below it, which computes
    an expensive array a second time.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | None = None,
                rank: str = "rank") -> DataFrame:
    """First ``k`` rows of every key, numbered; all rows without ``k``.

    The rank filter lets Spark cut each task's rows to ``k`` per key before the
    shuffle, so a hot key never arrives whole in one task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn(rank, F.row_number().over(window))
    return numbered if k is None else numbered.filter(F.col(rank) <= k)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the smallest by ``order`` (all ascending).

    An aggregate rather than a window, so duplicates are already merged map-side.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("first"))
    return picked.select(*keys, *[F.col(f"first.{c}").alias(c) for c in rest])


def best_by(df: DataFrame, keys: Sequence[str], score: str, tie: str) -> DataFrame:
    """Row with the highest score per key; the smaller ``tie`` wins equal scores."""
    return keep_first(df, keys, [-F.col(score), F.col(tie)])


def priority_union(first: DataFrame, *others: DataFrame, keys: Sequence[str],
                   order: str) -> DataFrame:
    """Rows of ``first``, then rows of the others whose key has not been seen."""
    stages = [df.withColumn("stage", F.lit(i)) for i, df in enumerate((first, *others))]
    merged = stages[0]
    for stage in stages[1:]:
        merged = merged.unionByName(stage)
    return keep_first(merged, keys, [F.col("stage"), F.col(order)])


def within_budget(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cost: str,
                  budget: int) -> DataFrame:
    """Leading rows of a key whose running cost stays within the budget.

    Costs are positive, so "stop at the first overflow" equals "running sum fits".
    """
    window = (Window.partitionBy(*keys).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("spent", F.sum(cost).over(window)).filter(F.col("spent") <= budget)


def bag_counts(df: DataFrame, keys: Sequence[str], item: str, k: int,
               min_count: int = 1) -> DataFrame:
    """The ``k`` most frequent items per key (ties alphabetical), then the count floor."""
    counts = df.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("n"))
    top = top_per_key(counts, keys, [F.desc("n"), F.asc(item)], k)
    return top.filter(F.col("n") >= min_count)


def update_column(table: DataFrame, key: str, column: str, changes: DataFrame) -> DataFrame:
    """Set one column for the listed keys; every other row and column is kept."""
    new = changes.select(key, F.struct(F.col(column).alias("value")).alias("_new"))
    joined = table.join(new, key, "left")
    return joined.select(*[
        F.when(F.col("_new").isNotNull(), F.col("_new.value")).otherwise(F.col(c)).alias(c)
        if c == column else F.col(c) for c in table.columns])


def replace_groups(table: DataFrame, keys: Sequence[str], fresh: DataFrame) -> DataFrame:
    """Delete every group that occurs in ``fresh`` and insert the fresh rows."""
    kept = table.join(fresh.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(fresh.select(*table.columns))


def first_inserted(events: DataFrame, key: str, at: str, size: int) -> DataFrame:
    """Keys that survive first-in eviction: the ``size`` latest first insertions.

    Inserting a key again keeps its place.
    """
    first = events.groupBy(key).agg(F.min(at).alias(at))
    return first.orderBy(F.desc(at), F.asc(key)).limit(size)


def recent_unique(events: DataFrame, owner: str, item: str, at: str, size: int) -> DataFrame:
    """Newest-first list of distinct items per owner, at most ``size`` long."""
    last = events.groupBy(owner, item).agg(F.max(at).alias(at))
    return top_per_key(last, [owner], [F.desc(at), F.asc(item)], size)


def toggled_on(events: DataFrame, owner: str, item: str, at: str, size: int) -> DataFrame:
    """Items toggled an odd number of times, newest toggle first, at most ``size``."""
    state = events.groupBy(owner, item).agg(F.count(F.lit(1)).alias("toggles"), F.max(at).alias(at))
    return top_per_key(state.filter(F.col("toggles") % 2 == 1), [owner],
                       [F.desc(at), F.asc(item)], size)
