"""Prefix trie of conversations by ROLLUP over columns of turn ids.

A conversation becomes rows of ``width`` turn ids, one row a block of turns.  One
ROLLUP over these columns gives every prefix inside the blocks at once, grouping_id its
length.  Longer conversations go on in further blocks, grouped with the node that ends the
block before; that node's key follows from the turns before it, so all blocks
are aggregated together and nothing loops over depths.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plansift.llm.base import table
from plansift.llm.manifest import crc_sql
from plansift.staging import stage

WIDTH = 6
#: A conversation takes over fewer than so many turns of the first conversation of its group of GROUP.
HEADS, GROUP = 6, 100
#: Neighbouring rows that are summed up together before sums run along a conversation.
RUN = 1024
#: Bytes of one piece of a list of ids.
PIECE = 1 << 16
#: Nodes with more than this share of all nodes as children are looked up by broadcast (fewer than its inverse).
WIDE = 1000


def places(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, pos (from 0 by turn, nulls first, then role and text), id (16 bytes of role and text), chars of every turn.

    Rows are range-partitioned down to single turns, so a long conversation is
    spread; positions come from row numbers inside the partitions and the sizes of
    a conversation's parts, and texts are shuffled once.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), role.alias("role"), text.alias("text"),
        F.monotonically_increasing_id().alias("row"))
    keys = ["conv", "turn", "role", "text", "row"]
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    rows = stage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"),
        F.unhex(F.substring(digest, 1, 32)).alias("id"), F.char_length("text").cast("long").alias("chars")), "turns")
    sizes = rows.groupBy("conv", "part").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    before = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("conv", "part", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(sizes, ["conv", "part"]).select("conv", (F.col("at") - F.col("start") + F.col("base")).alias("pos"), "id", "chars")


def head(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv, pos, id, chars) and all conversations (conv, also those left without turns)."""
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    convs = sizes.select("conv", (F.col("conv") - F.col("conv") % GROUP).alias("first"), head(F.col("conv")).alias("h"))
    firsts = turns.where((F.col("conv") % GROUP == 0) & (F.col("pos") < HEADS - 1)).select(F.col("conv").alias("first"), "pos", "id", "chars")
    taken = convs.join(firsts, "first").where(F.col("pos") < F.col("h")).select("conv", "pos", "id", "chars")
    # own turns move up where the first conversation had fewer than h, or does not exist
    short = convs.join(sizes.select(F.col("conv").alias("first"), F.col("n").alias("length")), "first", "left").select(
        "conv", F.greatest(F.lit(0), F.col("h") - F.coalesce("length", F.lit(0))).alias("gap")).where("gap > 0")
    own = turns.where(F.col("pos") >= head(F.col("conv"))).join(short, "conv", "left").select(
        "conv", (F.col("pos") - F.coalesce("gap", F.lit(0))).alias("pos"), "id", "chars")
    return taken.unionByName(own), convs.select("conv")


def running_before(rows: DataFrame, key: str, index: str, values: dict[str, str]) -> DataFrame:
    """Each row with, for every ``values`` entry (new name: expression of an aggregate), the aggregate over its key's rows of lower index.

    RUN neighbouring indices are aggregated first, then these runs along the key, then the
    rows inside a run: no task sorts more than a key's runs, or the rows of one.
    """
    run = F.expr(f"{index} div {RUN}").alias("run")
    runs = rows.groupBy(key, run).agg(*[F.expr(e).alias(n) for n, e in values.items()])
    fold = {n: e.split("(")[0] for n, e in values.items()}
    before = W.partitionBy(key).orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(key, "run", *[F.expr(f"{fold[n]}({n})").over(before).alias(f"{n}_runs") for n in values]).where(f"{next(iter(values))}_runs IS NOT NULL")
    inside = W.partitionBy(key, "run").orderBy(index).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("run", run).select("*", *[F.expr(e).over(inside).alias(n) for n, e in values.items()])
    joined = rows.join(runs, [key, "run"], "left")
    both = {n: F.coalesce(n, F.lit(0)).bitwiseXOR(F.coalesce(f"{n}_runs", F.lit(0))) if fold[n] == "bit_xor"
            else F.coalesce(n, F.lit(0)) + F.coalesce(f"{n}_runs", F.lit(0)) for n in values}
    return joined.select(*[c for c in rows.columns if c not in values and c != "run"], *[both[n].alias(n) for n in values])


def _key(part: int, pos: Column, turn: Column) -> Column:
    """Half of a prefix's key that a turn adds: its id hashed with its position."""
    return F.xxhash64(F.lit(part), pos.cast("long"), turn)


def blocks(turns: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """conv, block, x, y (key of the node before the block), t0.. (turn ids), c0.. (their characters) and length, one row a block.

    A conversation without turns has one block without turns.
    """
    slot = F.col("pos") % width
    turns = turns.withColumn("block", F.expr(f"pos div {width}")).withColumn("kx", _key(1, F.col("pos"), F.col("id"))).withColumn(
        "ky", _key(2, F.col("pos"), F.col("id")))
    rows = turns.groupBy("conv", "block").agg(
        *[F.max(F.when(slot == i, F.col("id"))).alias(f"t{i}") for i in range(width)],
        *[F.max(F.when(slot == i, F.col("chars"))).alias(f"c{i}") for i in range(width)],
        F.bit_xor("kx").alias("kx"), F.bit_xor("ky").alias("ky"), F.count("*").alias("length"))
    rows = running_before(stage(rows, "blocks"), "conv", "block", {"x": "bit_xor(kx)", "y": "bit_xor(ky)"})
    empty = convs.join(rows.where("block = 0").select("conv"), "conv", "left_anti").withColumns({"block": F.lit(0), "length": F.lit(0)})
    return rows.unionByName(empty, allowMissingColumns=True).fillna(0, ["x", "y", "kx", "ky"])


def _rollup(rows: DataFrame, width: int, sums: str) -> DataFrame:
    """All prefixes of the blocks: block, d (turns of the prefix inside its block), kx, ky (node), px, py (parent) and ``sums``.

    Prefixes that no conversation has (a null turn id) are left out, and so is the
    empty one of later blocks: it is the last node of the block before.
    """
    columns = [f"t{i}" for i in range(width)]
    found = rows.sparkSession.sql(
        f"SELECT block, x, y, {', '.join(columns)}, {width} - length(replace(bin(grouping_id()), '0', '')) AS d, {sums} "
        f"FROM {{rows}} GROUP BY block, x, y, ROLLUP({', '.join(columns)})", rows=rows)
    last = F.coalesce(*[F.when(F.col("d") == i + 1, F.col(c).isNotNull()) for i, c in enumerate(columns)], F.col("block") == 0)
    found = found.where(last)
    depth = F.col("block") * width + F.col("d")
    for half, start in ((1, "x"), (2, "y")):
        keys = [F.coalesce(_key(half, F.col("block") * width + i, F.col(c)), F.lit(0)) for i, c in enumerate(columns)]
        node = parent = F.col(start)
        for i, k in enumerate(keys):
            node = node.bitwiseXOR(F.when(F.col("d") > i, k).otherwise(0))
            parent = parent.bitwiseXOR(F.when(F.col("d") > i + 1, k).otherwise(0))
        found = found.withColumn(f"k{start}", node).withColumn(f"p{start}", parent)
    return found.withColumn("depth", depth.cast("long")).drop("x", "y", *columns)


def list_digests(ends: DataFrame) -> DataFrame:
    """kx, ky, ends_sha256: digest of the ids (``conv``) of each node, ascending and comma-joined.

    Ids are ordered by range partitions, so a node's list may lie in many; each
    writes its share in pieces of text, and one pass over a node's pieces feeds
    the digest, which keeps no list.
    """
    def pieces(batches):
        key, first, ids, size = None, None, [], 0
        rows = []

        def flush():
            if ids:
                rows.append((*key, first, ",".join(ids)))
        for batch in batches:
            for x, y, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (x, y) or size > PIECE:
                    flush()
                    key, first, ids, size = (x, y), conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if rows:
                yield _batch(rows, ("kx", "ky", "first", "piece"), (pa.int64(), pa.int64(), pa.int64(), pa.string()))
                rows = []
        flush()
        if rows:
            yield _batch(rows, ("kx", "ky", "first", "piece"), (pa.int64(), pa.int64(), pa.int64(), pa.string()))

    def digests(batches):
        key, state, rows = None, None, []
        for batch in batches:
            for x, y, _, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (x, y):
                    if key:
                        rows.append((*key, state.hexdigest()))
                    key, state = (x, y), hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if rows:
                yield _batch(rows, ("kx", "ky", "ends_sha256"), (pa.int64(), pa.int64(), pa.string()))
                rows = []
        if key:
            yield _batch([(*key, state.hexdigest())], ("kx", "ky", "ends_sha256"), (pa.int64(), pa.int64(), pa.string()))

    keys = ["kx", "ky", "conv"]
    ordered = ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    cut = ordered.mapInArrow(pieces, "kx long, ky long, first long, piece string")
    return cut.repartition("kx", "ky").sortWithinPartitions("kx", "ky", "first").mapInArrow(digests, "kx long, ky long, ends_sha256 string")


def _batch(rows, names, kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))


def with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with parent_conv_id and n_children.

    Nodes with over a thousandth of all nodes as children are fewer than a thousand: they are broadcast,
    so their children are not shuffled to one task; the others meet by key.
    """
    children = stage(nodes.where("depth > 0").groupBy(F.col("px").alias("kx"), F.col("py").alias("ky")).agg(F.count("*").alias("n_children")), "children")
    nodes = stage(nodes.join(children, ["kx", "ky"], "left").fillna(0, ["n_children"]), "nodes")
    limit = max(1, nodes.count() // WIDE)
    parents = nodes.select(F.col("kx").alias("px"), F.col("ky").alias("py"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    wide = parents.where(F.col("n_children") > limit).drop("n_children")
    first = nodes.where("depth > 0").join(F.broadcast(wide), ["px", "py"], "left")
    rest = first.where("parent_conv_id IS NULL").drop("parent_conv_id").join(
        parents.where(F.col("n_children").between(1, limit)).drop("n_children"), ["px", "py"])
    root = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return first.where("parent_conv_id IS NOT NULL").unionByName(rest).unionByName(root)


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                width: int = WIDTH, rebuilt: bool = True) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    Turns ascend by ``turn`` (nulls first), equal ones by role and text; null roles
    and texts are empty, repeated rows are turns of their own.  Rows without a
    conversation id belong to none and are left out.  ``rebuilt`` conversations open with
    turns of the first one of their hundred (ids are divided towards zero); otherwise they
    stay as they are.  A conversation may end up without turns: it is a member of the
    root.  An empty table gives no rows, not even a root.  Texts of any length count
    whole; other columns are not read, whatever their names.

    Prefixes are told apart by 128-bit keys of turns and positions.  The nodes whose
    smallest member is c are the end of c's path, so the sums over a subtree are the members' sums
    over their own nodes, less what c's nodes above it hold: a second ROLLUP gives them.
    """
    placed = stage(places(turns, conv, turn, role, text), "places")
    if rebuilt:
        rows, convs = rebuild(placed)
    else:
        rows, convs = placed, placed.select("conv").distinct()
    rows = stage(blocks(rows, convs, width), "conversation-blocks")
    chars = " ".join(f"WHEN c{i} IS NOT NULL AND grouping_id() = {2 ** (width - 1 - i) - 1} THEN c{i}" for i in range(width))
    nodes = stage(_rollup(rows, width, f"min(conv) AS conv_id, count(*) AS n_convs, coalesce(max(CASE {chars} END), 0) AS chars"), "prefixes")
    nodes = stage(with_parents(nodes).withColumn("own", (F.col("n_convs") - 1) * F.col("chars")), "trie")
    nodes = running_before(nodes, "conv_id", "depth", {"above": "sum(own)"})

    owned = nodes.groupBy(F.col("conv_id").alias("conv")).agg(F.sum("own").alias("own"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaf"))
    weighed = rows.join(owned, "conv", "left").fillna(0, ["own", "leaf"])
    below = _rollup(weighed, width, "sum(own) AS whole, sum(leaf) AS n_leaves").select("kx", "ky", "whole", "n_leaves")
    ends = rows.groupBy("conv").agg(F.bit_xor("kx").alias("kx"), F.bit_xor("ky").alias("ky"))
    return nodes.join(below, ["kx", "ky"]).join(list_digests(ends), ["kx", "ky"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("whole") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op11_conversations(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE = f"""
WITH placed AS (
  SELECT conv_id AS c, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, list(t ORDER BY pos) AS turns, {crc_sql('c::VARCHAR')} % 6 AS h FROM placed GROUP BY c),
rebuilt AS (
  SELECT a.c, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns
  FROM convs a LEFT JOIN convs b ON b.c = a.c - a.c % 100),
prefixes AS (SELECT c, d, len(turns) AS n, turns[1:d] AS path FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(length(path[d].text), 0) AS own,
         coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends
  FROM prefixes GROUP BY d, path),
children AS (SELECT path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
counted AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.path = c.path),
below AS (
  SELECT path[1:i] AS path, sum(own) AS own, sum((n_children = 0)::INT) AS leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS i FROM counted) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.leaves::BIGINT AS n_leaves,
       b.own::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM counted n JOIN below b ON n.path = b.path
LEFT JOIN nodes p ON n.d > 0 AND p.path = n.path[1:n.d - 1]
"""
