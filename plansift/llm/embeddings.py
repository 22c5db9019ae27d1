"""Near-duplicate vectors: a neighbour graph by NN-descent, its threshold edges, and exact counts inside components."""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from plansift.llm.base import table
from plansift.llm.components import components
from plansift.staging import stage

#: Single-precision cosines are taken this much below a bound and then judged in double precision.
SLACK = 1e-4


@dataclass(frozen=True)
class Descent:
    """``lists``: neighbours kept for each vector.  ``trees``: random-projection trees that give the first graph, fitted on
    ``sample_rows``, leaves of about ``leaf_rows``.  ``rounds`` at most, fewer once under ``settled`` of the edges are new.
    ``audited`` vectors are compared with all others; below ``recall`` as many trees again and more rounds follow, at most
    ``repeats`` times.  ``block_rows``: vectors of one component compared in a task.
    """
    lists: int = 12
    trees: int = 8
    leaf_rows: int = 256
    sample_rows: int = 16384
    rounds: int = 6
    settled: float = 0.001
    audited: int = 256
    recall: float = 0.98
    repeats: int = 3
    block_rows: int = 1024


def prepare(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(vec_id, key, unit): unit vector in double precision as bytes, key of the vector; both null where it links with nothing."""
    source = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    kind = dict(source.dtypes)["vec_id"]

    def run(batches):
        for batch in batches:
            keys, units = [], []
            for v in batch.column(1).to_pylist():
                x = np.array(v if v is not None and None not in v else [], np.float64)
                top = np.abs(x).max(initial=0.0)
                if not len(x) or not np.isfinite(top) or top == 0:  # max() of a NaN is a NaN
                    keys.append(None)
                    units.append(None)
                else:
                    x = x + 0.0  # one zero
                    keys.append(hashlib.md5(x.tobytes()).digest())
                    x = x / top  # no overflow in the norm
                    units.append((x / np.sqrt(x @ x)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(units, pa.binary())],
                                             names=["vec_id", "key", "unit"])

    return source.mapInArrow(run, f"vec_id {kind}, key binary, unit binary")


def grow_trees(sample: list[bytes], rows: int, how: Descent, seed: int) -> dict[int, list]:
    """By vector length: trees of (direction, cut, left, right), a leaf is its number; cuts are medians of the sample."""
    rng, by_length = np.random.default_rng(seed), {}
    for v in sample:
        by_length.setdefault(len(v), []).append(np.frombuffer(v, np.float64))
    out = {}
    for length, some in sorted(by_length.items()):
        x, scale = np.array(some), rows / max(1, len(sample))
        out[length] = []
        for _ in range(how.trees):
            leaves = iter(range(1 << 30))

            def grow(at):
                if len(at) * scale <= how.leaf_rows or len(at) < 16:
                    return next(leaves)
                direction = rng.standard_normal(x.shape[1]).astype(np.float32)
                along = x[at].astype(np.float32) @ direction
                cut = float(np.median(along))
                if not (along > cut).any():
                    return next(leaves)
                return (direction, cut, grow(at[along <= cut]), grow(at[along > cut]))
            out[length].append(grow(np.arange(len(x))))
    return out


def _leaves(tree, x: np.ndarray) -> np.ndarray:
    leaf, todo = np.zeros(len(x), np.int64), [(tree, np.arange(len(x)))]
    while todo:
        node, at = todo.pop()
        if not isinstance(node, tuple):
            leaf[at] = node
        elif len(at):
            low = x[at] @ node[0] <= node[1]
            todo += [(node[2], at[low]), (node[3], at[~low])]
    return leaf


def _best(u, v, sim, k: int):
    """The ``k`` most similar rows of each ``u``, each (u, v) once."""
    order = np.lexsort((v, -sim, u))
    u, v, sim = u[order], v[order], sim[order]
    again = np.zeros(len(u), bool)
    again[1:] = (u[1:] == u[:-1]) & (v[1:] == v[:-1])
    u, v, sim = u[~again], v[~again], sim[~again]
    first = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
    rank = np.arange(len(u)) - np.repeat(first, np.diff(np.append(first, len(u))))
    keep = rank < k
    return u[keep], v[keep], sim[keep]


def _near_pairs(nodes, x, least: float, k: int):
    """(u, v, sim) of the ``k`` most similar others of each row at ``least`` or more, in blocks of rows."""
    us, vs, sims = [], [], []
    for i in range(0, len(nodes), 512):
        s = x[i:i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        if len(nodes) > k:
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        else:
            top = np.broadcast_to(np.arange(len(nodes)), s.shape)
        value = np.take_along_axis(s, top, 1)
        a, b = np.nonzero(value >= least)
        us.append(nodes[i + a])
        vs.append(nodes[top[a, b]])
        sims.append(value[a, b])
    return tuple(np.concatenate(c) if c else np.zeros(0) for c in (us, vs, sims))


def _edge_table(u, v, sim) -> pa.Table:
    return pa.table({"u": pa.array(u.astype(np.int64)), "v": pa.array(v.astype(np.int64)), "sim": pa.array(sim.astype(np.float32))})


_EDGES = "u long, v long, sim float"


def first_graph(nodes: DataFrame, rows: int, near: float, how: Descent, seed: int) -> DataFrame:
    """Edges between vectors that share a leaf of a random-projection tree."""
    sample = [bytes(r[0]) for r in nodes.orderBy(F.xxhash64("node")).limit(how.sample_rows).select("unit").collect()]
    trees = grow_trees(sample, rows, how, seed)

    def route(batches):
        for batch in batches:
            ids, units = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            lengths = np.array([len(u) for u in units])
            out = []
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                x = np.frombuffer(b"".join([units[i] for i in at]), np.float64).reshape(len(at), -1).astype(np.float32)
                for t, tree in enumerate(trees.get(length, [0])):
                    leaf = _leaves(tree, x)
                    for k in np.unique(leaf).tolist():
                        some = leaf == k
                        out.append((f"{length}/{t}/{k}", ids[at[some]].tobytes(), x[some].tobytes()))
            columns = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.binary(), pa.binary()))],
                                             names=["leaf", "nodes", "units"])

    def compare(key, leaf):
        ids = np.frombuffer(b"".join(leaf.column("nodes").to_pylist()), np.int64)
        x = np.frombuffer(b"".join(leaf.column("units").to_pylist()), np.float32).reshape(len(ids), -1)
        return _edge_table(*_near_pairs(ids, x, near, how.lists))

    leaves = nodes.select("node", "unit").mapInArrow(route, "leaf string, nodes binary, units binary")
    return leaves.groupBy("leaf").applyInArrow(compare, _EDGES)


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each ``u``; ``new`` is true for edges that were not in a list before."""
    once = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    rank = F.row_number().over(W.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def descend(graph: DataFrame, nodes: DataFrame, near: float, how: Descent) -> DataFrame:
    """One round: all neighbours of a vector, and those that name it, are compared with each other where one edge is new.

    Of those that name a vector the most similar ``2 * lists`` take part, so a
    hub's group stays bounded.
    """
    both = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim", "new"))
    around = _lists(both, 2 * how.lists).withColumnRenamed("u", "center").withColumnRenamed("v", "node")
    active = around.filter("new").select("center").distinct()
    sent = around.join(active, "center", "left_semi").join(nodes.select("node", "unit"), "node")
    parts = 4 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.select(F.pmod(F.xxhash64("center"), F.lit(parts)).cast("int").alias("part"), "center", "node", "new", "unit")

    def narrow(batches):
        for batch in batches:
            units = [np.frombuffer(u, np.float64).astype(np.float32).tobytes() for u in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(units, pa.binary())], names=batch.schema.names)

    def compare(key, rows):
        center, node, new = (rows.column(c).to_numpy() for c in ("center", "node", "new"))
        units, found = rows.column("unit").to_pylist(), []
        order = np.argsort(center, kind="stable")
        edges = np.append(np.flatnonzero(np.append(True, np.diff(center[order]) != 0)), len(order))
        for a, b in zip(edges[:-1], edges[1:]):
            at = order[a:b]
            x = np.frombuffer(b"".join([units[i] for i in at]), np.float32).reshape(len(at), -1)
            s = x @ x.T
            i, j = np.nonzero((s >= near) & (new[at][:, None] | new[at][None, :]) & ~np.eye(len(at), dtype=bool))
            found.append((node[at[i]], node[at[j]], s[i, j]))
        u, v, sim = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        return _edge_table(*_best(u, v, sim, how.lists))

    sent = sent.mapInArrow(narrow, "part int, center long, node long, new boolean, unit binary")
    found = sent.groupBy("part").applyInArrow(compare, _EDGES).withColumn("new", F.lit(True))
    return _lists(graph.withColumn("new", F.lit(False)).unionByName(found), how.lists)


def neighbour_graph(nodes: DataFrame, rows: int, near: float, how: Descent, seed: int, start: DataFrame | None = None) -> DataFrame:
    graph = first_graph(nodes, rows, near, how, seed).withColumn("new", F.lit(True))
    if start is not None:
        graph = graph.unionByName(start.withColumn("new", F.lit(False)))
    graph = stage(_lists(graph, how.lists), "graph")
    for _ in range(how.rounds):
        graph = stage(descend(graph, nodes, near, how), "graph")
        edges, new = graph.agg(F.count("*"), F.count_if("new")).first()
        if new <= how.settled * edges:
            break
    return graph


def linked(graph: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the graph's edges whose cosine in double precision is at ``threshold`` or more."""
    pairs = graph.filter(F.col("sim") >= threshold - SLACK).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    both = pairs.join(nodes.select(F.col("node").alias("a"), F.col("unit").alias("x")), "a")
    both = both.join(nodes.select(F.col("node").alias("b"), F.col("unit").alias("y")), "b").select("a", "b", "x", "y")

    def judge(batches):
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = [float(np.frombuffer(p, np.float64) @ np.frombuffer(q, np.float64)) >= threshold for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return both.mapInArrow(judge, "a long, b long")


def count_links(members: DataFrame, threshold: float, block: int, parts: int) -> DataFrame:
    """(node, links): rows at ``threshold`` or more in the node's component, by their number of copies.

    ``members``: node, root, unit, n, size (of the component).  Links never
    leave a component, so this is exact for the components given, and the
    neighbour lists of saturated vectors are enlarged as far as they can be.
    Components over ``block`` rows are cut into blocks, each pair of blocks
    compared in a task; only counts leave it.
    """
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    cut = members.withColumn("blocks", blocks).withColumn("own", own)
    small = F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(parts)).cast("string"))
    large = cut.filter("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    name = F.concat_ws("/", F.col("root").cast("string"), F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string"))
    columns = ["grp", "root", "own", "node", "n", "unit"]
    groups = cut.filter("blocks = 1").withColumn("grp", small).select(*columns).unionByName(
        large.withColumn("grp", name).select(*columns))

    def compare(key, rows):
        root, own, node, n = (rows.column(c).to_numpy() for c in ("root", "own", "node", "n"))
        x = rows.column("unit").to_pylist()
        first, second = (key[0].as_py().split("/") + ["", ""])[1:3]
        nodes, counts = [], []
        order = np.argsort(root, kind="stable")
        edges = np.append(np.flatnonzero(np.append(True, np.diff(root[order]) != 0)), len(order))
        for a, b in zip(edges[:-1], edges[1:]):
            at = order[a:b]
            m = np.frombuffer(b"".join([x[i] for i in at]), np.float64).reshape(len(at), -1)
            sides = [np.flatnonzero(own[at] == o) for o in np.unique(own[at])]
            if len(sides) == 2:
                turns = [(sides[0], sides[1]), (sides[1], sides[0])]
            elif first == second:
                turns = [(np.arange(len(at)),) * 2]
            else:  # the other block is empty
                turns = []
            for left, right in turns:
                for i in range(0, len(left), 512):
                    near = m[left[i:i + 512]] @ m[right].T >= threshold
                    if first == second:
                        near[np.arange(len(near)), np.arange(i, i + len(near))] = False
                    nodes.append(node[at[left[i:i + 512]]])
                    counts.append(near @ n[at[right]])
        nodes, counts = (np.concatenate(c) if c else np.zeros(0) for c in (nodes, counts))
        return pa.table({"node": pa.array(nodes.astype(np.int64)), "links": pa.array(counts.astype(np.int64))})

    return groups.groupBy("grp").applyInArrow(compare, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def cross_links(placed: DataFrame, loose: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b): for each vector of ``loose`` (node) and each other component, one vector at ``threshold`` or more, if any.

    Exact: blocks of ``loose`` against blocks of all of ``placed`` (node, root,
    unit), a pair of blocks in a task.
    """
    lone = placed.join(loose, "node", "left_semi")
    left, right = (max(1, -(-df.count() // block)) for df in (lone, placed))

    def side(df, n, other, mine):
        own = F.pmod(F.xxhash64("node"), F.lit(n)).cast("int")
        far = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        df = df.select("node", "root", "unit", own.alias("own"), far.alias("far"), F.lit(mine).alias("asks"))
        name = F.concat_ws("/", *(("own", "far") if mine else ("far", "own")))
        return df.select(name.alias("grp"), "asks", "node", "root", "unit")

    def compare(key, rows):
        asks, node, root = (rows.column(c).to_numpy() for c in ("asks", "node", "root"))
        units = rows.column("unit").to_pylist()
        lengths, found = np.array([len(u) for u in units]), []
        for length in np.unique(lengths).tolist():
            p, q = (np.flatnonzero((lengths == length) & (asks == side)) for side in (True, False))
            if not len(p) or not len(q):
                continue
            q = q[np.argsort(root[q], kind="stable")]
            x, y = (np.frombuffer(b"".join([units[i] for i in at]), np.float64).reshape(len(at), -1) for at in (p, q))
            first = np.flatnonzero(np.append(True, np.diff(root[q]) != 0))
            for i in range(0, len(p), 512):
                some = p[i:i + 512]
                near = (x[i:i + 512] @ y.T >= threshold) & (root[some][:, None] != root[q][None, :])
                a, g = np.nonzero(np.logical_or.reduceat(near, first, axis=1))
                at = [first[k] + int(near[j, first[k]:].argmax()) for j, k in zip(a, g)]
                found.append((node[some[a]], node[q[np.array(at, np.int64)]]))
        a, b = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    both = side(lone, left, right, True).unionByName(side(placed, right, left, False))
    return both.groupBy("grp").applyInArrow(compare, "a long, b long")


def saturated(graph: DataFrame, threshold: float, k: int) -> DataFrame:
    """(node) of the vectors whose list is full and still linked at its end: others may be missing from it."""
    last = graph.groupBy("u").agg(F.count("*").alias("kept"), F.min("sim").alias("least"))
    return last.filter((F.col("kept") >= k) & (F.col("least") >= threshold - SLACK)).select(F.col("u").alias("node"))


def audit(nodes: DataFrame, links: DataFrame, threshold: float, rows: int) -> float:
    """Share of the links of ``rows`` vectors, chosen by hash and compared with all, that ``links`` (node, links) has."""
    chosen = nodes.orderBy(F.xxhash64("node", F.lit(7))).limit(rows).select("node", "unit").collect()
    by_length: dict[int, list] = {}
    for r in chosen:
        by_length.setdefault(len(r.unit), []).append((r.node, bytes(r.unit)))

    def compare(batches):
        for batch in batches:
            ids, units, n = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            out: dict[int, int] = {}
            for length, some in by_length.items():
                at = np.array([i for i, u in enumerate(units) if len(u) == length], np.int64)
                if len(at):
                    x = np.frombuffer(b"".join([units[i] for i in at]), np.float64).reshape(len(at), -1)
                    q = np.frombuffer(b"".join([u for _, u in some]), np.float64).reshape(len(some), -1)
                    near = (q @ x.T >= threshold) & (ids[at][None, :] != np.array([k for k, _ in some])[:, None])
                    for (k, _), c in zip(some, (near @ n[at]).tolist()):
                        out[k] = out.get(k, 0) + c
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.int64())],
                                             names=["node", "there"])

    there = nodes.select("node", "unit", "n").mapInArrow(compare, "node long, there long").groupBy("node").agg(F.sum("there").alias("there"))
    total, found = there.join(links, "node", "left").agg(F.sum("there"), F.sum(F.coalesce("links", F.lit(0)))).first()
    return 1.0 if not total else found / total


def near_vectors(vectors: DataFrame, threshold: float = 0.9, how: Descent = Descent(), id_column: str = "vec_id",
                 vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing; vectors of different lengths do not link.  Equal
    vectors are one node that carries their number, so copies link by count.
    Neighbours under cos(2 acos(threshold)) are not kept: no two vectors that
    link with a common third are less similar than that.  A vector whose list
    is full of links is compared with all vectors of other components, so links
    between them are found.  Rows without id
    lend no name to their component and are not kept.  Other columns are not
    read.
    """
    near = 2 * threshold * threshold - 1
    rows = stage(prepare(vectors, id_column, vector), "vectors")
    classes = rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"),
                                                               F.first("unit").alias("unit"))
    nodes = stage(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    total = nodes.count()
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def place(pairs):
        roots = components(pairs)
        return stage(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")

    def joined(pairs, placed, loose):
        """Components with the links that leave those of ``placed`` at ``loose``."""
        cross = stage(cross_links(placed, loose, threshold, how.block_rows), "cross")
        return placed if cross.isEmpty() else place(stage(pairs, "pairs").unionByName(cross))

    def count(placed):
        sizes = placed.groupBy("root").agg(F.count("*").alias("size")).filter("size > 1")
        members = placed.join(sizes, "root").select("node", "root", "unit", "n", "size")
        return stage(count_links(members, threshold, how.block_rows, parts), "counts")

    graph = None
    for seed in range(how.repeats + 1):
        graph = neighbour_graph(nodes, total, near - SLACK, how, seed, graph)
        pairs = linked(graph, nodes, threshold)
        placed = place(pairs)
        # a full list hides links that leave its component: those vectors meet all others
        loose = stage(saturated(graph, threshold, how.lists), "loose")
        if not loose.isEmpty():
            placed = joined(pairs, placed, loose)
        links = count(placed)
        if audit(nodes, links, threshold, how.audited) >= how.recall:
            break
    else:  # all vectors meet all others
        placed = joined(placed.select(F.col("node").alias("a"), F.col("root").alias("b")), placed, nodes.select("node"))
        links = count(placed)
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(names, "root").join(links, "node", "left").select(
        "key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    done = rows.drop("unit").join(placed, "key", "left")
    own = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
                       F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))


def op3_embeddings(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
          AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""
