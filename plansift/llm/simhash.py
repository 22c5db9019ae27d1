"""Near-duplicate texts: SimHash fingerprints, linked through vantage-point trees."""
from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.llm.base import Words, fresh, mix, slices, table, texts_of
from plansift.llm.components import components
from plansift.llm.overlap import id_column, prefix_links
from plansift.staging import stage

SEED = 42


def fingerprint(text: bytes, size: int = 4, rows: int = 1 << 14) -> int:
    """64-bit SimHash of the lower-cased ``size``-word shingles; zero for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) > size else [b" ".join(words)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), rows):
        bits = np.unpackbits(hashes[i:i + rows].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), to: str = "fp",
                 shingle_words: int = 4) -> DataFrame:
    """The columns ``keep`` and ``to``, the fingerprint as a signed long; a null text counts as empty."""
    n, here = len(keep), fresh("body", keep)
    source = docs.select(*keep, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(here))
    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:n]] + [f"`{to}` long"])

    def run(batches):
        for batch in batches:
            made = np.array([fingerprint(t, shingle_words) for t in texts_of(batch.column(n))], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(made.view(np.int64))],
                                             names=[*keep, to])

    return source.mapInArrow(run, types)


@dataclass
class Tree:
    """Vantage-point tree over the bits of ``mask``: arrays by node, leaves by number.

    ``left`` and ``right`` are nodes, or leaves as -1 - leaf.  ``share`` has
    the shares of points and of queries that the sample sends to each leaf.
    """
    mask: int
    radius: int
    vantage: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    root: int
    share: list[tuple[float, float]]

    def route(self, points: np.ndarray, queries: np.ndarray):
        """(leaf, indices of its points, indices of the queries whose ball reaches it)"""
        todo = [(self.root, np.arange(len(points)), np.arange(len(queries)))]
        while todo:
            node, p, q = todo.pop()
            if not len(q):
                continue
            if node < 0:
                yield -1 - node, p, q
                continue
            dp, dq = _distance(points[p], self.vantage[node], self.mask), _distance(queries[q], self.vantage[node], self.mask)
            cut = self.cut[node]
            todo.append((self.left[node], p[dp <= cut], q[dq <= cut + self.radius]))
            todo.append((self.right[node], p[dp > cut], q[dq > cut - self.radius]))


def _distance(x: np.ndarray, vantage, mask) -> np.ndarray:
    return np.bitwise_count((x ^ np.uint64(vantage)) & np.uint64(mask)).astype(np.int16)


def _split(points: np.ndarray, queries: np.ndarray, mask: int, radius: int, tries: int = 12):
    """(vantage, cut) with the fewest comparisons left, or None where no cut saves a tenth of them."""
    best, choice = 0.9 * len(points) * len(queries), None
    for vantage in points[:: max(1, len(points) // tries)][:tries]:
        p = np.cumsum(np.bincount(_distance(points, vantage, mask), minlength=66))
        q = np.cumsum(np.bincount(_distance(queries, vantage, mask), minlength=66))
        for cut in range(64):
            inside, outside = q[min(cut + radius, 65)], q[-1] - (q[cut - radius] if cut >= radius else 0)
            cost = p[cut] * inside + (p[-1] - p[cut]) * outside
            if cost < best:
                best, choice = cost, (vantage, cut)
    return choice


def build_tree(sample: np.ndarray, rows: float, mask: int, radius: int, leaf_rows: int, least: int = 32) -> Tree:
    """Tree whose leaves are to hold about ``leaf_rows`` of ``rows`` rows each, as far as the sample can tell."""
    nodes, share, scale = [], [], rows / max(1, len(sample))

    def grow(p, q):
        cut = _split(p, q, mask, radius) if len(p) * scale > leaf_rows and len(p) >= least else None
        if cut is None:
            share.append((len(p) / max(1, len(sample)), len(q) / max(1, len(sample))))
            return -len(share)
        nodes.append(None)
        me, (vantage, at) = len(nodes) - 1, cut
        dp, dq = _distance(p, vantage, mask), _distance(q, vantage, mask)
        left = grow(p[dp <= at], q[dq <= at + radius])
        nodes[me] = (vantage, at, left, grow(p[dp > at], q[dq > at - radius]))
        return me

    root = grow(sample, sample)
    columns = list(zip(*nodes)) if nodes else [(), (), (), ()]
    return Tree(mask, radius, np.array(columns[0], np.uint64), *(np.array(c, np.int64) for c in columns[1:]), root, share)


def block_masks(blocks: int) -> list[int]:
    """Masks of ``blocks`` runs of bits that together are all 64."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]


class Groups:
    """Union of linked items, by rounds of array operations; pairs are taken in bulk and not kept."""

    def __init__(self, n: int, bulk: int = 1 << 20):
        self.root, self.bulk, self.held, self.waiting = np.arange(n), bulk, [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        new = self.root[a] != self.root[b]
        if new.any():
            self.held.append((a[new], b[new]))
            self.waiting += int(new.sum())
            if self.waiting >= self.bulk:
                self.merge()

    def merge(self) -> np.ndarray:
        if self.held:
            a, b = (np.concatenate(x) for x in zip(*self.held))
            self.held, self.waiting = [], 0
            while True:
                x, y = self.root[a], self.root[b]
                new = x != y
                if not new.any():
                    break
                a, b, x, y = a[new], b[new], x[new], y[new]
                np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
                while not np.array_equal(again := self.root[self.root], self.root):
                    self.root = again
        return self.root


def links_in_shard(points: np.ndarray, queries: np.ndarray, mask: int, radius: int, bits: int,
                   leaf: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what is linked (a spanning forest, not all pairs): point-query pairs at ``bits`` or fewer.

    The tree goes on inside the shard, on all rows of it; at a leaf every
    query is compared with every point by all 64 bits.
    """
    both = np.unique(np.concatenate([points, queries]))
    groups = Groups(len(both))
    todo = [(np.searchsorted(both, points), np.searchsorted(both, queries))]
    while todo:
        p, q = todo.pop()
        if not len(p) or not len(q):
            continue
        some_p, some_q = p[:: max(1, len(p) // 256)], q[:: max(1, len(q) // 256)]
        cut = _split(both[some_p], both[some_q], mask, radius, 4) if len(p) > leaf else None
        if cut is not None:
            dp, dq = _distance(both[p], cut[0], mask), _distance(both[q], cut[0], mask)
            todo.append((p[dp <= cut[1]], q[dq <= cut[1] + radius]))
            todo.append((p[dp > cut[1]], q[dq > cut[1] - radius]))
            continue
        step = max(1, (1 << 20) // len(p))
        for i in range(0, len(q), step):
            some = q[i:i + step]
            near = np.bitwise_count(both[some][:, None] ^ both[p][None, :]) <= bits
            a, b = np.nonzero(near)
            groups.add(some[a], p[b])
    root = groups.merge()
    moved = np.flatnonzero(root != np.arange(len(both)))
    return both[moved], both[root[moved]]


def near_links(fps: DataFrame, bits: int = 4, blocks: int = 3, leaf_rows: int = 2048, sample_rows: int = 16384,
               chunk_rows: int = 131072) -> DataFrame:
    """(a, b): edges among the distinct longs of column ``fp`` that join all pairs at ``bits`` or fewer differing bits.

    Pairs within ``bits`` differ in at most bits // blocks bits of one of the
    ``blocks`` runs of bits.  For each run, a vantage-point tree fitted on a
    bounded sample (``sample_rows``) divides all fingerprints by their Hamming
    distance within the run; each goes to its own leaf as a point, and as a
    query to every leaf that the triangle bound cannot rule out.  Leaves over
    ``chunk_rows`` points or queries are divided into blocks of both, each
    pair of blocks a task of its own.  Exact: the bounds lose no pair.
    """
    rows = fps.count()
    sample = np.array([r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).collect()],
                      np.int64).view(np.uint64)
    trees = [build_tree(sample, rows, mask, bits // blocks, leaf_rows) for mask in block_masks(blocks)]
    chunks = [[tuple(max(1, int(np.ceil(s * rows / chunk_rows))) for s in leaf) for leaf in t.share] for t in trees]

    def route(batches):
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            keys, points, queries = [], [], []
            for t, tree in enumerate(trees):
                for leaf, p, q in tree.route(x, x):
                    np_, nq = chunks[t][leaf]
                    for i in range(np_):
                        for j in range(nq):
                            a, b = x[p][x[p] % np.uint64(np_) == i], x[q][x[q] % np.uint64(nq) == j]
                            keys.append(f"{t}/{leaf}/{i}/{j}")
                            points.append(a.tobytes())
                            queries.append(b.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(points, pa.binary()),
                                              pa.array(queries, pa.binary())], names=["shard", "points", "queries"])

    def link(key, shard):
        tree = trees[int(key[0].as_py().split("/")[0])]
        points, queries = (np.frombuffer(b"".join(shard.column(c).to_pylist()), np.uint64) for c in ("points", "queries"))
        a, b = links_in_shard(points, queries, tree.mask, tree.radius, bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    shards = fps.select("fp").mapInArrow(route, "shard string, points binary, queries binary")
    return shards.groupBy("shard").applyInArrow(link, "a long, b long")


def group_fingerprints(fps: DataFrame, id_column: str = "doc_id", bits: int = 4) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint.

    component_id: the smallest id reachable, nulls passed over; root: the smallest fingerprint.
    """
    nodes = stage(fps.groupBy("fp").agg(F.min(id_column).alias("least")), "fingerprints")
    roots = components(near_links(nodes.select("fp"), bits))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other; rows
    without doc_id stay and lend no name to their component (it is null where
    no member has one).  Repeated rows share a fingerprint; other columns are
    not read.
    """
    fps = stage(fingerprints(docs), "fp")
    groups = group_fingerprints(fps, bits=bits)
    return fps.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def word_prints(words: np.ndarray, prints: int) -> np.ndarray:
    """``prints`` independent SimHashes of a set of word hashes; zeros for none."""
    if not len(words):
        return np.zeros(prints, np.int64)
    step = np.arange(prints, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    bits = np.unpackbits(mix(np.unique(words)[None, :] + step).view(np.uint8), axis=1, bitorder="little").reshape(prints, -1, 64)
    ones = np.add.reduce(bits, axis=1, dtype=np.uint32)
    return np.packbits(2 * ones > bits.shape[1], axis=1, bitorder="little").view(np.int64)[:, 0]


def _keyed(docs: DataFrame, text: str, prints: int = 0) -> DataFrame:
    """``docs`` with ``key`` (MD5 of the lower-cased words) and, if asked for, ``f``: prints of the set of words."""
    at, names = docs.columns.index(text), docs.columns
    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["key string"]
                      + ["f array<long>"] * bool(prints))

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(at))
            made = [pa.array([hashlib.md5(b" ".join(t.lower().split())).hexdigest() for t in texts], pa.string())]
            if prints:
                found = []
                for a, b in slices(texts):
                    words = Words(texts[a:b], lower=True)
                    found += [word_prints(words.hash[i:j], prints) for i, j in zip(words.first[:-1], words.first[1:])]
                made.append(pa.array(found, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, "key"] + ["f"] * bool(prints))

    return docs.mapInArrow(run, types)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    words = Words([text], lower=True)
    found = words.windows(size)[1]
    return np.unique(found if len(found) else words.hash.sum(keepdims=True))


def similar_in_group(sets: list[np.ndarray], similarity: float, columns: int = 8192) -> np.ndarray:
    """Smallest index that each set is linked to, through Jaccard similarities of ``similarity`` or more."""
    size = np.array([len(x) for x in sets])
    kinds, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(inverse, kind="stable")
    edges = np.searchsorted(inverse[order], np.arange(0, len(kinds) + columns, columns))
    for low, (a, b) in zip(range(0, len(kinds), columns), zip(edges, edges[1:])):
        some = order[a:b]
        block = np.zeros((len(sets), min(columns, len(kinds) - low)), np.float32)
        block[row[some], inverse[some] - low] = 1
        common += block @ block.T
    groups = Groups(len(sets))
    groups.add(*np.nonzero(common >= similarity * (size[:, None] + size[None, :] - common) - 1e-3))
    return groups.merge()


def similar_groups(docs: DataFrame, text: str, ids: str, similarity: float = 0.8, size: int = 5, prints: int = 4, bits: int = 7,
                   blocks: int = 4, block: int = 512) -> tuple[DataFrame, DataFrame]:
    """(nodes, roots): different texts (key, node, least), and (node, root) of those linked with others.

    Candidates: texts of which one of ``prints`` SimHashes of the set of words
    differs in ``bits`` or fewer bits, found through vantage-point trees; texts
    that differ in few words agree there more closely than by shingles.  Texts
    with a long inserted or cut passage may not, so pairs that the prefix filter
    cannot rule out (``overlap``) are candidates too, which makes them complete.
    Then exact: inside each component of candidates the sets of ``size``-word
    shingles are compared, in pairs of blocks of ``block`` texts, and
    similarities of ``similarity`` or more link.
    """
    rows = stage(_keyed(docs.select(ids, text), text, prints).select(ids, "key", "f"), "prints")
    nodes = stage(rows.groupBy("key").agg(F.min(ids).alias("least"), F.first("f").alias("f"))
                  .withColumn("node", F.monotonically_increasing_id()), "nodes")
    near = None
    for i in range(prints):
        own = stage(nodes.groupBy(F.col("f")[i].alias("fp")).agg(F.min("node").alias("rep")), "own")
        same = nodes.select(F.col("node").alias("a"), F.col("f")[i].alias("fp")).join(own, "fp").select("a", F.col("rep").alias("b"))
        links = near_links(own.select("fp"), bits, blocks)
        links = links.join(own.withColumnsRenamed({"fp": "a", "rep": "x"}), "a").join(own.withColumnsRenamed({"fp": "b", "rep": "y"}), "b")
        links = same.unionByName(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
        near = links if near is None else near.unionByName(links)
    own = stage(nodes.select(id_column("key").alias("id"), "node"), "own")
    links = prefix_links(docs, text, similarity, size).join(own.withColumnsRenamed({"id": "a", "node": "x"}), "a")
    links = links.join(own.withColumnsRenamed({"id": "b", "node": "y"}), "b")
    near = near.unionByName(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    placed = nodes.join(components(near), "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = placed.groupBy("root").agg(F.count("*").alias("size")).filter("size > 1")
    members = stage(placed.join(sizes, "root").select("key", "node", "root", "size"), "members")
    once = _keyed(docs.select(text), text).groupBy("key").agg(F.first(text).alias("body"))
    n_blocks = F.ceil(F.col("size") / block).cast("int")
    parts = 16 + members.count() // block
    cut = once.join(members, "key").withColumn("blocks", n_blocks).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    small = F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(parts)).cast("string"))
    large = F.concat_ws("/", F.col("root").cast("string"), F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string"))
    cut = cut.select(F.when(F.col("blocks") == 1, small).otherwise(large).alias("part"), "root", "node", "body")

    def shingles(batches):
        for batch in batches:
            sets = [shingle_set(t, size).tobytes() for t in texts_of(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], names=["part", "root", "node", "sets"])

    def compare(key, rows):
        root, node, sets = rows.column("root").to_numpy(), rows.column("node").to_numpy(), rows.column("sets").to_pylist()
        order = np.argsort(root, kind="stable")
        edges, a, b = np.append(np.flatnonzero(np.append(True, np.diff(root[order]) != 0)), len(order)), [], []
        for low, high in zip(edges, edges[1:]):
            at = order[low:high]
            linked = similar_in_group([np.frombuffer(sets[i], np.uint64) for i in at], similarity)
            moved = np.flatnonzero(linked != np.arange(len(at)))
            a.append(node[at[moved]])
            b.append(node[at[linked[moved]]])
        return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})

    shingled = cut.mapInArrow(shingles, "part string, root long, node long, sets binary")
    return nodes.select("key", "node", "least"), components(shingled.groupBy("part").applyInArrow(compare, "a long, b long"))


def keep_one(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id, all columns as they are.

    Texts whose sets of five-word shingles (lower-cased) have a Jaccard
    similarity of ``similarity`` or more are linked; texts without words are
    equal.  Of rows repeated with the same words one stays.  A group without
    any doc_id keeps one of its rows.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    moved = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()])
    ids, text = own["doc_id"], own["text"]
    nodes, roots = similar_groups(moved, text, ids, similarity)
    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "key")).alias("first")
    kept = stage(placed.groupBy("root").agg(first).select("first.key", F.col("first.least").alias("id")), "kept")
    rows = _keyed(moved, text).join(kept, "key")
    # of the rows with the text that stays, the one with the id that stays
    return rows.filter(F.col(ids).eqNullSafe(F.col("id"))).dropDuplicates(["key"]).select(*[F.col(a).alias(c) for c, a in own.items()])


def op1_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
