"""What the operators share: words, rolling hashes, slices of Arrow batches, numbering, stages."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plansift.staging import stage

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are turned into numpy arrays at a time (one longer text goes alone).
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


#: Rows of an Arrow batch: texts may be very long, and a batch is held whole by the executor and by its Python worker.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows from here on; smaller settings stay."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, taken) -> str:
    """``name``, lengthened until no column in ``taken`` has it (case does not count)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE_BYTES):
    """Ranges (from, to) of neighbouring texts of at most ``limit`` bytes together."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of SplitMix64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[key] = np.cumprod(table, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Words:
    """Words of several texts: ``hash`` of each, ``doc`` it is in, bytes ``data[start:end]``.

    ``spaces`` marks the bytes that part words; LF must be one of them.
    """

    def __init__(self, texts: list[bytes], lower: bool = False, spaces: np.ndarray = _SPACE):
        data = b"\n".join(texts) + b"\n"
        self.data = data.lower() if lower else data  # bytes.lower() changes A-Z only
        a = np.frombuffer(self.data, np.uint8)
        space = spaces[a]
        before = np.empty_like(space)
        before[0], before[1:] = True, space[:-1]
        self.start, self.end = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
        up, down = _powers(len(a))
        total = np.empty(len(a) + 1, np.uint64)
        total[0] = 0
        np.cumsum(a * up, out=total[1:])
        length = (self.end - self.start).astype(np.uint64)
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + length)
        first = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        self.doc = np.searchsorted(first, self.start, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def windows(self, size: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Start (index of its first word) and hash of every run of ``size`` words inside one text."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        factor, total = np.uint64(1), np.zeros(n, np.uint64)
        step = np.uint64(pow(_BASE, 2 * seed + 1, 1 << 64))
        for k in range(size):
            factor = np.uint64((int(factor) * int(step)) & ((1 << 64) - 1))
            total += self.hash[k:k + n] * factor
        inside = np.flatnonzero(self.doc[:n] == self.doc[size - 1:size - 1 + n])
        return inside, mix(total[inside])


def number_within(df: DataFrame, groups: list[str], order: list[str], to: str) -> DataFrame:
    """``df`` with ``to``: 0, 1, 2 ... inside each group, in the order of ``order``.

    Rows are range-partitioned by groups and order, so a group with a third of
    all rows is spread over many tasks; tasks count their rows of each group,
    and only these counts (tasks x groups) are summed up.  The divided rows are
    written once, so that counts and numbers come from the same division.
    """
    part = fresh("part", df.columns)
    keys = [F.col(c) for c in (*groups, *order)]
    parts = stage(df.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()), "numbered")
    sizes = parts.groupBy(part, *groups).agg(F.count("*").alias("n"))
    before = W.partitionBy(*[F.col(g) for g in groups]).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    sizes = stage(sizes.select(F.col(part).alias("p"), *[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)],
                               F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    here = W.partitionBy(part, *[F.col(g) for g in groups]).orderBy(*[F.col(c) for c in order])
    rows = parts.withColumn(to, F.row_number().over(here) - 1)
    same = F.col(part) == F.col("p")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"g{i}"))
    return rows.join(sizes, same).select(*df.columns, (F.col(to) + F.col("base")).cast("long").alias(to))
