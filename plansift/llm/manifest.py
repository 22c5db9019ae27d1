"""Merkle manifest of a data set: a proof for every row, made and checked by exchange of subtrees.

Rows are leaves; per tree (a language) they ascend by id.  Superblocks of 2**height
neighbouring leaves are reduced on their own, their tops are the leaves of the next,
2**height times smaller table, and so on up to the root.  On the way down leaves and
the nodes that a superblock needs from outside are cogrouped by superblock: one
function finishes the local levels, joins them with the outer proof and folds.
"""
from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansift.llm.base import number_within, table
from plansift.staging import stage

#: Superblocks of at most 2 ** HEIGHT nodes.
HEIGHT = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A step of a proof: the side of the sibling and its digest, or ALONE where the run has no other node.
LEFT, RIGHT, ALONE = "L", "R", "-"


def field(value: Column) -> Column:
    """Byte count, colon and value; ``-`` for a null."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def local_levels(block: int, nodes: list[str], height: int) -> list[list[str]]:
    """The nodes of a superblock and each level above them, up to its top.

    A superblock behind the first belongs to a tree that is higher than it, so it
    climbs all its levels, a lone node by itself.  The first is either full or the whole tree.
    """
    levels = [nodes]
    for _ in range(height if block else (len(nodes) - 1).bit_length()):
        below = levels[-1]
        levels.append([digest("".join(below[i:i + 2])) for i in range(0, len(below), 2)])
    return levels


def steps(levels: list[list[str]], at: int) -> list[str]:
    """Steps from node ``at`` of the lowest level to the top of its superblock."""
    found = []
    for level in levels[:-1]:
        other = at ^ 1
        found.append((LEFT if other < at else RIGHT) + level[other] if other < len(level) else ALONE)
        at >>= 1
    return found


def fold(leaf: str, proof: list[str]) -> str:
    for step in proof:
        other = step[1:]
        leaf = digest(other + leaf if step[0] == LEFT else leaf + other)
    return leaf


def _superblocks(nodes: DataFrame, height: int):
    return nodes.withColumn("block", F.shiftright("pos", height)).groupBy("tree", "block")


def _reduce(nodes: DataFrame, height: int) -> DataFrame:
    """tree, pos, digest of the superblocks' tops."""
    def top(key, rows):
        rows = rows.sort_values("pos")
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]],
                             "digest": [local_levels(key[1], rows.digest.tolist(), height)[-1][0]]})
    return _superblocks(nodes.select("tree", "pos", "digest"), height).applyInPandas(top, "tree string, pos long, digest string")


def _climb(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Tables of ever higher nodes; the last holds one node of each tree."""
    tables = [nodes]
    while True:
        tables.append(stage(_reduce(tables[-1], height), "manifest-tops"))
        if not tables[-1].agg(F.max("pos")).first()[0]:
            return tables


def _descend(nodes: DataFrame, outer: DataFrame, height: int) -> DataFrame:
    """tree, pos, proof (comma-joined steps to the root), subroot, root of each node; ``outer`` has them for the superblocks."""
    def extend(key, rows, above):
        rows = rows.sort_values("pos")
        levels = local_levels(key[1], rows.digest.tolist(), height)
        above = above.iloc[0]
        tail = [above.proof] if above.proof else []
        return pd.DataFrame({"tree": key[0], "pos": rows.pos, "subroot": above.subroot, "root": above.root,
                             "proof": [",".join(steps(levels, i) + tail) for i in range(len(rows))]})
    below, above = _superblocks(nodes.select("tree", "pos", "digest"), height), outer.withColumnRenamed("pos", "block").groupBy("tree", "block")
    return below.cogroup(above).applyInPandas(extend, "tree string, pos long, subroot string, root string, proof string")


def _down(tables: list[DataFrame], outer: DataFrame, height: int) -> DataFrame:
    """Proofs of the nodes of the second table, from those of the last."""
    for nodes in reversed(tables[1:-1]):
        outer = stage(_descend(nodes, outer, height), "manifest-proofs")
    return outer


def prove(docs: DataFrame, key: str = "doc_id", tree: str = "lang", fields: tuple[str, ...] = FIELDS,
          presented: Column | None = None, height: int = HEIGHT, with_proof: bool = True) -> DataFrame:
    """key, leaf, subroot, root, proof, proof_sha256, folded_root, verified for every row of ``docs``.

    A leaf is the digest of the row's ``fields``; ``presented`` is the digest that
    is offered for verification (the leaf itself by default), folded with the
    row's proof.  Trees are the values of ``tree``, a null one is a tree of its
    own and comes first, an empty one second; a tree of one row has that leaf as
    its subroot.  Null fields count as ``-`` and empty ones as ``0:``; rows with
    one key ascend by their leaf, repeated rows have equal leaves and keep a
    place each; null keys come first.  Texts of any length are hashed inside the
    scan and not shuffled.  An empty table gives no rows.  Other columns are not
    read, whatever their names.

    Rows are numbered by range partitions, so a tree that holds a third of all
    rows is spread like any other; superblocks hold at most 2 ** height rows.
    The driver sees one number a level.
    """
    leaf = leaf_digest([F.col(f) for f in fields])
    # a leading sign keeps the null tree apart from the empty one and leaves the order of bytes as it is
    name = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))
    leaves = stage(docs.select(F.col(key).alias("id"), name.alias("tree"), leaf.alias("digest"),
                               (leaf if presented is None else presented).alias("presented"),
                               F.monotonically_increasing_id().alias("row")), "manifest-leaves")
    leaves = stage(number_within(leaves, ["tree"], ["id", "digest", "row"], "pos").drop("row"), "manifest-places")

    trees = _climb(leaves, height)
    subroots = stage(number_within(trees[-1].select("tree", "digest", F.lit(0).alias("one")), ["one"], ["tree"], "pos"), "manifest-subroots")
    forest = _climb(subroots.select(F.lit("").alias("tree"), "pos", "digest"), height)
    root = forest[-1].select("tree", "pos", F.lit("").alias("proof"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    ends = _descend(forest[0], _down(forest, root, height), height).select("pos", "proof", "root")
    ends = subroots.join(ends, "pos").select("tree", F.lit(0).cast("long").alias("pos"), "proof", F.col("digest").alias("subroot"), "root")
    outer = _down(trees, stage(ends, "manifest-subroot-proofs"), height)

    def finish(key, rows, above):
        rows = rows.sort_values("pos")
        levels, above = local_levels(key[1], rows.digest.tolist(), height), above.iloc[0]
        tail = above.proof.split(",") if above.proof else []
        outside = "".join(s[1:] for s in tail)
        sums, folded, proofs = [], [], []
        for i, offered in enumerate(rows.presented):
            local = steps(levels, i)
            sums.append(digest("".join([s[1:] for s in local]) + outside))
            folded.append(fold(fold(offered, local), tail))
            if with_proof:
                proofs.append(",".join(local + tail))
        return pd.DataFrame({"id": rows.id, "leaf": rows.digest, "subroot": above.subroot, "root": above.root,
                             "proof": proofs if with_proof else None, "proof_sha256": sums, "folded_root": folded})

    schema = "id string, leaf string, subroot string, root string, proof string, proof_sha256 string, folded_root string"
    kind = docs.schema[key].dataType
    texts = leaves.select("tree", "pos", "digest", "presented", F.col("id").cast("string").alias("id"))  # pandas has no nullable long
    rows = _superblocks(texts, height).cogroup(outer.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInPandas(finish, schema)
    columns = ["leaf", "subroot", "root", *(["proof"] if with_proof else []), "proof_sha256", "folded_root"]
    return rows.select(F.col("id").cast(kind).alias(key), *columns, (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_manifest(spark, sf_dir):
    """Every seventh id (by CRC-32) presents a row whose n_chars is one too high."""
    longer = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    fields = {f: F.col(f) for f in FIELDS}
    presented = F.when(chosen, leaf_digest(list((fields | {"n_chars": longer}).values()))).otherwise(leaf_digest(list(fields.values())))
    return prove(table(spark, sf_dir, "documents"), presented=presented, with_proof=False)


_CRC = ("list_reduce(flatten([[4294967295], flatten(list_transform(list_transform(string_split({x}, ''), lambda c: ascii(c)),"
        " lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))]), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)"
        " ELSE xor(a >> 1, 3988292384 * (a & 1)) END)")


def crc_sql(x: str) -> str:
    """DuckDB text for the unsigned CRC-32 of an ASCII string."""
    return f"xor({_CRC.format(x=x)}::BIGINT, 4294967295)"


def _leaf_sql(n_chars: str) -> str:
    parts = [f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in
             ("doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text")]
    return f"sha256({' || '.join(parts)})"


ORACLE = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf,
         CASE WHEN {crc_sql('doc_id::VARCHAR')} % 7 = 0 THEN {_leaf_sql('n_chars + 1')} ELSE {_leaf_sql('n_chars')} END AS offered
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
nodes AS (
  SELECT lang, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM nodes
  WHERE n > 1 GROUP BY lang, level, n, pos // 2),
subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, level AS height FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, n, pos // 2),
whole AS (
  SELECT n.lang, n.level, n.pos, n.h, s.pos AS above, s.height FROM nodes n JOIN subroots s ON n.lang IS NOT DISTINCT FROM s.lang),
paths AS (
  SELECT doc_id, lang, leaf, offered AS folded, '' AS proof, 0 AS level, pos FROM placed
  UNION ALL
  SELECT p.doc_id, p.lang, p.leaf,
         sha256(CASE WHEN o.h IS NULL THEN p.folded WHEN p.at % 2 = 0 THEN p.folded || o.h ELSE o.h || p.folded END),
         p.proof || coalesce(o.h, ''), p.level + 1, p.pos // 2
  FROM (SELECT p.*, s.height, s.pos AS above, p.level < s.height AS inside,
               CASE WHEN p.level < s.height THEN p.pos ELSE s.pos // (2 ** (p.level - s.height))::BIGINT END AS at
        FROM paths p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
        WHERE p.level < s.height + (SELECT max(level) FROM tops)) p
  LEFT JOIN (SELECT lang, true AS inside, level, pos, h FROM whole WHERE level < height
             UNION ALL
             SELECT s.lang, false, s.height + t.level, t.pos, t.h FROM subroots s CROSS JOIN tops t) o
  ON o.lang IS NOT DISTINCT FROM p.lang AND o.inside = p.inside AND o.level = p.level AND o.pos = xor(p.at, 1))
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(p.proof) AS proof_sha256, p.folded AS folded_root, p.folded = r.h AS verified
FROM paths p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
CROSS JOIN (SELECT h, level FROM tops WHERE n = 1) r
WHERE p.level = s.height + r.level
"""
