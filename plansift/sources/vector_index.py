"""The stored vector index: coarse cells, vectors written by cell, cells pruned by the triangle inequality.

    <path>/cells       cell, center, n, radius        at most MAX_CELLS rows
    <path>/vectors/cell=C/   *keys, vec, dist         sorted by distance from the centre
    <path>/columns     no rows, the columns of the vectors

With v = c + r and |r| <= radius, v.q is at most c.q + radius * |q|: a cell whose bound
lies under the k-th similarity found so far holds no neighbour.  The same bound with
a vector's own distance skips vectors, and row groups of a cell, before any product is taken.

Similarities are dot products, in double precision, of unit or other vectors.  They are rounded
to 12 digits before ranking, so the order of additions does not decide ties.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plansift.operators.relational import small_batches, top_per_key, union_all
from plansift.staging import stage

#: vectors that the cells are learned on: those with the lowest hash of their keys
SAMPLE = 20_000
MAX_CELLS = 1_024
ROUNDS = 8
#: vectors of a cell that one file holds, and the parts a cell may be written in
FILE_ROWS = 200_000
#: cells are opened first until they hold so many times the wanted neighbours
SEED_FACTOR = 4
DIGITS = 12
SLACK = 1e-9


def matrix(column: pa.Array, rows: np.ndarray | None = None) -> np.ndarray:
    """Vectors of equal length as the rows of a matrix."""
    column = column if rows is None else column.take(pa.array(rows))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def learn_cells(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres by Lloyd's rounds from evenly spaced sample rows; an emptied cell keeps its centre."""
    centers = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        near = nearest_center(sample, centers)[0]
        sums, counts = np.zeros_like(centers), np.bincount(near, minlength=cells)
        np.add.at(sums, near, sample)
        centers[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centers


def nearest_center(vectors: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    near = np.argmin((centers ** 2).sum(1)[None, :] - 2 * vectors @ centers.T, axis=1)
    return near, np.sqrt(((vectors - centers[near]) ** 2).sum(1))


def write_vectors(vectors: DataFrame, path: str, keys: Sequence[str] = ("page_id",), vec: str = "vec",
                  cells: int | None = None, sample: int = SAMPLE) -> None:
    """Write ``vectors`` (``*keys``, ``vec``) by cell; null vectors are left out, all others have one length.

    Every vector is placed; only the centres come from the sample.  Large cells
    are dealt over several files.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(vec).isNotNull()).select(*keys, F.col(vec).alias("vec"))
    learned = rows.select("vec", F.xxhash64(*keys).alias("h")).orderBy("h").limit(sample).select("vec").toArrow()
    known = matrix(learned["vec"].combine_chunks()) if learned.num_rows else np.zeros((1, 1))
    count = rows.count()
    cells = min(MAX_CELLS, len(known), cells or max(1, int(np.sqrt(count))))
    centers = learn_cells(known, cells)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                near, dist = nearest_center(matrix(batch.column(batch.num_columns - 1)), centers)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dist), pa.array(near.astype(np.int32))],
                                                 names=[*batch.schema.names, "dist", "cell"])
    placed = stage(rows.mapInArrow(place, f"{kinds}, dist double, cell int"), "placed-vectors")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius"))
    found = {r["cell"]: r for r in sizes.collect()}  # one row a cell
    parts = max(1, -(-max((r["n"] for r in found.values()), default=0) // FILE_ROWS))
    part = F.pmod(F.xxhash64(*keys), F.lit(parts))
    (placed.repartition("cell", part).sortWithinPartitions("cell", "dist").write.mode("overwrite").partitionBy("cell")
     .parquet(f"{path}/vectors"))
    about = pa.table({"cell": pa.array(sorted(found), pa.int32()), "center": [centers[c].tolist() for c in sorted(found)],
                      "n": pa.array([found[c]["n"] for c in sorted(found)], pa.int64()),
                      "radius": pa.array([found[c]["radius"] for c in sorted(found)], pa.float64())},
                     pa.schema([("cell", pa.int32()), ("center", pa.list_(pa.float64())), ("n", pa.int64()), ("radius", pa.float64())]))
    placed.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")
    spark.createDataFrame(about).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def products(vectors: DataFrame, queries: np.ndarray, k: int, asked: dict[int, np.ndarray] | None = None,
             centers: np.ndarray | None = None, least: np.ndarray | None = None) -> DataFrame:
    """``*keys, q, cos``: the ``k`` nearest rows of each query in every task, by one matrix product a batch.

    ``asked`` lists the queries of each cell, ``least`` what a query still has to reach.  At most a few times
    ``k`` rows a query are kept at any time.
    """
    keys = [c for c in vectors.columns if c not in ("vec", "dist", "cell")]
    celled = "cell" in vectors.columns
    order = vectors.select(*keys, "vec", *(["dist", "cell"] if celled else []))
    norms = np.sqrt((queries ** 2).sum(1))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in order.select(*keys).schema.fields)

    def cut(table: pa.Table) -> pa.Table:
        by = [("q", "ascending"), ("cos", "descending"), *[(c, "ascending") for c in keys]]
        table = table.sort_by(by)
        q = table["q"].to_numpy()
        first = np.searchsorted(q, q)
        return table.filter(pa.array(np.arange(len(q)) - first < k))

    def search(batches):
        kept, waiting = None, []
        for batch in batches:
            whole = batch.column(len(keys))
            groups = [(np.arange(batch.num_rows), np.arange(len(queries)))]
            if celled:
                cell = batch.column(len(keys) + 2).to_numpy(zero_copy_only=False)
                groups = [(np.flatnonzero(cell == c), asked[int(c)]) for c in np.unique(cell)]
            for rows, wanted in groups:
                if not len(rows) or not len(wanted):
                    continue
                if least is not None:  # a vector's own distance bounds its similarity to each query
                    dist = batch.column(len(keys) + 1).to_numpy(zero_copy_only=False)[rows]
                    reach = centers[int(cell[rows[0]])] @ queries[wanted].T + dist.max() * norms[wanted]
                    wanted = wanted[reach >= least[wanted] - SLACK]
                    if not len(wanted):
                        continue
                sims = np.round(matrix(whole, rows) @ queries[wanted].T, DIGITS)
                if len(rows) > k:  # ties at the k-th stay, so that keys decide them
                    edge = np.partition(sims, len(rows) - k, axis=0)[len(rows) - k]
                    at, q = np.nonzero(sims >= edge)
                else:
                    at, q = np.nonzero(np.ones_like(sims, bool))
                found = pa.Table.from_batches([batch]).select(keys).take(pa.array(rows[at]))
                waiting.append(found.append_column("q", pa.array(wanted[q].astype(np.int32))).append_column("cos", pa.array(sims[at, q])))
            if sum(t.num_rows for t in waiting) > 4 * k * len(queries) + 10_000:
                kept, waiting = cut(pa.concat_tables([*([kept] if kept else []), *waiting])), []
        if waiting:
            kept = cut(pa.concat_tables([*([kept] if kept else []), *waiting]))
        if kept is not None:
            yield from kept.combine_chunks().to_batches()
    return order.mapInArrow(search, f"{kinds}, q int, cos double")


def _queries(some: DataFrame) -> tuple[list, np.ndarray]:
    """One batch of queries, on the driver (``relational.BATCH_ROWS`` about)."""
    rows = some.filter(F.col("vec").isNotNull()).select("qid", "vec").toArrow()
    return rows["qid"].to_pylist(), matrix(rows["vec"].combine_chunks()) if rows.num_rows else np.zeros((0, 1))


def _ranked(found: DataFrame, some: DataFrame, ids: list, keys: list[str], k: int) -> DataFrame:
    kind = some.schema["qid"].dataType
    names = some.sparkSession.createDataFrame(pa.table({"q": pa.array(range(len(ids)), pa.int32()), "qid": pa.array(ids)}))
    rows = found.join(F.broadcast(names.select("q", F.col("qid").cast(kind).alias("qid"))), "q").drop("q")
    top = top_per_key(rows, ["qid"], [F.desc("cos"), *[F.asc(c) for c in keys]], k)
    return top.select("qid", *keys, "cos", "rank")


def nearest_rows(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``qid, *keys, cos, rank`` by comparing every vector of a table: one scan per batch of queries."""
    keys = [c for c in vectors.columns if c != "vec"]
    found = []
    for some in small_batches(queries, "qid"):
        ids, q = _queries(some)
        rows = vectors.filter(F.col("vec").isNotNull()) if ids else vectors.limit(0)
        found.append(_ranked(products(rows, q, k), some, ids, keys, k))
    return union_all(found)


@dataclass
class VectorIndex:
    """An index as it stands when it is opened; ``opened`` counts the cells that the last search read, of ``cells`` times its queries."""
    spark: SparkSession
    path: str

    def __post_init__(self):
        about = self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").toArrow()
        self.cells, self.n = about["cell"].to_numpy(), about["n"].to_numpy()
        self.radius = about["radius"].to_numpy()
        known = matrix(about["center"].combine_chunks())
        self.centers = np.zeros((int(self.cells.max()) + 1 if len(self.cells) else 0, known.shape[1]))
        self.centers[self.cells] = known
        self.opened = self.pairs = 0

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/columns").schema).parquet(f"{self.path}/vectors")

    def _open(self, chosen: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None) -> DataFrame | None:
        """Search the chosen (cell, query) pairs; other cells' folders are not read."""
        self.opened += int(chosen.sum())
        at = np.flatnonzero(chosen.any(1))
        if not len(at):
            return None
        asked = {int(self.cells[i]): np.flatnonzero(chosen[i]) for i in at}
        rows = self.vectors().filter(F.col("cell").isin(list(asked)))
        return products(rows, queries, k, asked, self.centers, least)

    def nearest(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """``qid, *keys, cos, rank``: the ``k`` nearest of each query (``qid, vec``).

        Exact without ``probes``: the most promising cells first, then every cell whose
        bound reaches the k-th similarity.  With ``probes`` only so many cells of the
        nearest centres are read, which may miss neighbours.
        """
        keys = [c for c in self.vectors().columns if c not in ("vec", "dist", "cell")]
        found, self.opened, self.pairs = [], 0, 0
        for some in small_batches(queries, "qid"):
            ids, q = _queries(some)
            if not ids or not len(self.cells):
                continue
            self.pairs += len(self.cells) * len(ids)
            middle = self.centers[self.cells] @ q.T
            bound = middle + self.radius[:, None] * np.sqrt((q ** 2).sum(1))[None, :]
            by = np.argsort(-middle, axis=0, kind="stable")
            position = np.argsort(by, axis=0, kind="stable")
            if probes is not None:
                hits = self._open(position < probes, q, k)
            else:
                held = np.cumsum(self.n[by], axis=0)
                enough = (held < SEED_FACTOR * k).sum(0) + 1
                seeds = position < enough[None, :]
                first = stage(self._open(seeds, q, k), "first-cells")
                kth = top_per_key(first, ["q"], [F.desc("cos"), *[F.asc(c) for c in keys]], k).filter(F.col("rank") == k)
                least = np.full(len(ids), -np.inf)
                for r in kth.select("q", "cos").collect():  # one row a query of the batch
                    least[r["q"]] = r["cos"]
                rest = self._open(~seeds & (bound >= least[None, :] - SLACK), q, k, least)
                hits = first if rest is None else first.unionByName(rest)
            found.append(_ranked(hits, some, ids, keys, k))
        if not found:
            return self.vectors().limit(0).select(F.lit(None).cast(queries.schema["qid"].dataType).alias("qid"), *keys, F.lit(0.0).alias("cos"), F.lit(0).alias("rank"))
        return union_all(found)
