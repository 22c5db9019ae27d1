"""Exact repeats between texts, found through fixed-block anchors, and their removal."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.llm.base import Words, mix, slices, table, texts_of
from plansift.staging import stage

WINDOW = 13
#: Text bytes whose windows meet in one bucket; buckets follow the input, so a bucket's size does not.
BUCKET_BYTES = 1 << 24
#: Rows without an id compare as the greatest.
LAST = (1 << 63) - 1


def pack_steps(at: np.ndarray) -> bytes:
    """Rising numbers as steps of a byte; 255 adds to the next."""
    step = np.diff(at, prepend=0)
    more = step // 255
    out = np.full(len(at) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = step % 255
    return out.tobytes()


def unpack_steps(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return np.cumsum(raw, dtype=np.int64)[raw != 255]


_BUCKET = "bucket int, ids binary, keys binary, none binary, marks binary, sizes binary, at binary, hashes binary"
_NAMES = [c.split()[0] for c in _BUCKET.split(", ")]


def _deal(words: Words, starts: np.ndarray, hashes: np.ndarray, docs: dict[str, np.ndarray], buckets: int, kind) -> pa.RecordBatch:
    """Windows of a slice by bucket, with the documents they are from; ``at`` has their first words, counted in the slice."""
    bucket = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = {c: [] for c in _NAMES}
    for b in range(buckets):
        some = order[edges[b]:edges[b + 1]]
        if not len(some):
            continue
        at = starts[some]
        used = np.unique(words.doc[at])  # only the documents with windows here
        skip = np.zeros(len(words.count), np.int64)  # words of documents left out before each
        skip[used] = words.first[used] - np.concatenate([[0], np.cumsum(words.count[used])[:-1]])
        for c, v in zip(_NAMES, (b, np.diff(docs["id"][used], prepend=0).tobytes(), np.diff(docs["key"][used], prepend=0).tobytes(),
                                 docs["none"][used].tobytes(), docs["mark"][used].tobytes() if "mark" in docs else b"",
                                 words.count[used].astype(np.uint32).tobytes(), pack_steps(at - skip[words.doc[at]]),
                                 hashes[some].astype(kind).tobytes())):
            rows[c].append(v)
    kinds = [pa.int32()] + [pa.binary()] * 7
    return pa.RecordBatch.from_arrays([pa.array(rows[c], k) for c, k in zip(_NAMES, kinds)], names=_NAMES)


def _gather(bucket: pa.Table, kind):
    """Arrays of all windows of a bucket (doc index, position, hash) and of its documents (id, key, none, mark)."""
    ids, keys, none, marks, docs, positions, hashes, seen = [], [], [], [], [], [], [], 0
    for row in bucket.to_pylist():
        size = np.frombuffer(row["sizes"], np.uint32).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        at = unpack_steps(row["at"])
        doc = np.searchsorted(first, at, "right") - 1
        ids.append(np.cumsum(np.frombuffer(row["ids"], np.int64)))
        keys.append(np.cumsum(np.frombuffer(row["keys"], np.int64)))
        none.append(np.frombuffer(row["none"], bool))
        marks.append(np.frombuffer(row["marks"], np.int64) if row["marks"] else np.zeros(len(size), np.int64))
        docs.append(doc + seen)
        positions.append((at - first[doc]).astype(np.uint32))
        hashes.append(np.frombuffer(row["hashes"], kind))
        seen += len(size)
    return tuple(np.concatenate(x) for x in (ids, keys, none, marks, docs, positions, hashes))


_FOUND = "part int, keys binary, none binary, marks binary, counts binary, at binary"


def _sorted(keys, none, marks, position):
    """Places by document, each once; where each document begins, with the end."""
    order = np.lexsort((position, marks, keys, none))
    columns = [c[order] for c in (keys, none, marks, position)]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:3]])
    keep = new.copy()
    keep[1:] |= columns[3][1:] != columns[3][:-1]
    return (*(c[keep] for c in columns), np.append(np.flatnonzero(new[keep]), int(keep.sum())))


def _found(keys, none, marks, doc, position, parts: int) -> pa.Table:
    """What a bucket found, a row for each part of the documents (by hash of the key), so rows do not follow documents."""
    keys, none, marks, position, edges = _sorted(keys[doc], none[doc], marks[doc], position)
    part = (mix(keys[edges[:-1]].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    rows = []
    for p in np.unique(part).tolist():
        some = np.flatnonzero(part == p)
        first, count = edges[some], (edges[some + 1] - edges[some])
        at = np.concatenate([position[a:a + n] for a, n in zip(first.tolist(), count.tolist())])
        rows.append((p, keys[first].tobytes(), none[first].tobytes(), marks[first].tobytes(), count.astype(np.uint32).tobytes(),
                     at.tobytes()))
    columns = list(zip(*rows)) if rows else [()] * 6
    return pa.table({n.split()[0]: pa.array(c, pa.int32() if i == 0 else pa.binary())
                     for i, (n, c) in enumerate(zip(_FOUND.split(", "), columns))})


def _by_document(found: DataFrame) -> DataFrame:
    """(key, none, mark, at): one row for each document with the places that all buckets found in it."""
    def merge(key, rows):
        columns = []
        for name, kind in (("keys", np.int64), ("none", bool), ("marks", np.int64), ("counts", np.uint32), ("at", np.uint32)):
            columns.append(np.frombuffer(b"".join(rows.column(name).to_pylist()), kind))
        keys, none, marks = (np.repeat(c, columns[3]) for c in columns[:3])
        keys, none, marks, position, edges = _sorted(keys, none, marks, columns[4])
        first = edges[:-1]
        return pa.table({"key": pa.array(keys[first]), "none": pa.array(none[first]), "mark": pa.array(marks[first]),
                         "at": pa.array([position[a:b].tobytes() for a, b in zip(first, edges[1:])], pa.binary())})

    return found.groupBy("part").applyInArrow(merge, "key long, none boolean, mark long, at binary")


def _groups(hashes: np.ndarray):
    """Order by hash, where each group begins, and each row's group."""
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def anchors(rows: DataFrame, block: int, buckets: int) -> DataFrame:
    """(key, none, at): blocks of ``block`` words that a document shares with another of which they are a reference block.

    Every document's non-overlapping blocks are the index, every one of its
    rolling windows of the same length is a probe.  Both go, as 32 bits of
    their hash and their place, to the bucket that the other bits name; a
    chance hit only adds a place that the extension then rejects.  A hit is
    reported for both documents.
    """
    def deal(batches):
        for batch in batches:
            texts = texts_of(batch.column(3))
            for a, b in slices(texts):
                words = Words(texts[a:b])
                docs = {n: batch.column(i).slice(a, b - a).to_numpy(zero_copy_only=False) for i, n in enumerate(("id", "key", "none"))}
                starts, hashes = words.windows(block)
                if len(starts):
                    yield _deal(words, starts, hashes, docs, buckets, np.uint32)

    def match(key, bucket):
        ids, keys, none, marks, doc, position, hashes = _gather(bucket, np.uint32)
        order, first, group = _groups(hashes)
        own = ids[doc[order]]
        index = position[order] % block == 0
        least = np.minimum.reduceat(np.where(index, own, LAST), first)
        most = np.maximum.reduceat(own, first)
        hit = (least[group] < own) | (index & (most[group] > own))
        some = order[hit]
        return _found(keys, none, marks, doc[some], position[some], buckets)

    dealt = rows.select("id", "key", "none", "body").mapInArrow(deal, _BUCKET)
    return _by_document(dealt.groupBy("bucket").applyInArrow(match, _FOUND)).drop("mark")


def repeats(rows: DataFrame, block: int, window: int, buckets: int) -> DataFrame:
    """(key, none, mark, at): windows that also start in a document with a smaller id.

    ``rows``: id, key, none, mark, body, at (places of anchors).  Anchors are
    extended to all windows around them; these are grouped by their hash, and
    the smallest id of each is kept.  Neighbouring windows make up maximal
    repeats.  No pairs of documents are formed.
    """
    def deal(batches):
        for batch in batches:
            texts, hits = texts_of(batch.column(4)), batch.column(5).to_pylist()
            for a, b in slices(texts):
                words = Words(texts[a:b])
                docs = {n: batch.column(i).slice(a, b - a).to_numpy(zero_copy_only=False)
                        for i, n in enumerate(("id", "key", "none", "mark"))}
                near = np.zeros(len(words.hash) + window, np.int32)
                for i, at in enumerate(hits[a:b]):
                    at = np.frombuffer(at, np.uint32).astype(np.int64)
                    at = at[at + block <= words.count[i]] + words.first[i]
                    np.add.at(near, np.maximum(at - (window - block), 0), 1)
                    np.add.at(near, at + 1, -1)
                starts, hashes = words.windows(window, seed=2)
                open_ = np.cumsum(near)[starts] > 0
                if open_.any():
                    yield _deal(words, starts[open_], hashes[open_], docs, buckets, np.uint64)

    def match(key, bucket):
        ids, keys, none, marks, doc, position, hashes = _gather(bucket, np.uint64)
        order, first, group = _groups(hashes)
        own = ids[doc[order]]
        some = order[np.minimum.reduceat(own, first)[group] < own]
        return _found(keys, none, marks, doc[some], position[some], buckets)

    dealt = rows.select("id", "key", "none", "mark", "body", "at").mapInArrow(deal, _BUCKET)
    return _by_document(dealt.groupBy("bucket").applyInArrow(match, _FOUND))


def covered_words(n: int, places: bytes, window: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    at = np.frombuffer(places, np.uint32).astype(np.int64)
    step[at] += 1  # places differ
    step[at + window] -= 1
    return np.cumsum(step)[:n] > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (text of the words kept, joined by a space) for every row of ``docs``.

    A word goes if a window of ``window`` words over it also starts in a row
    with a smaller id.  Null and empty texts have no words.  Rows of one id
    never count against each other; rows without id compare as the greatest
    and not against each other.  Other columns are not read.

    Reference blocks have half a window's words, so every shared window
    contains one.  Texts are shuffled once, to meet their anchors; after that
    only those that have anchors move.
    """
    block = (window + 1) // 2
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"),
                       F.coalesce(F.col(key).cast("long"), F.xxhash64(body)).alias("key"), F.col(key).isNull().alias("none"),
                       body.alias("body"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    found = stage(anchors(rows, block, buckets), "anchors")
    met = rows.join(found, ["key", "none"], "left")

    # texts without anchors are kept as they are; the others are written with their anchors
    def plain(batches):
        for batch in batches:
            texts, hits = texts_of(batch.column(4)), batch.column(5).to_pylist()
            split = [None if h else t.split() for t, h in zip(texts, hits)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], batch.column(5), pa.array([0 if s is None else len(s) for s in split], pa.int64()),
                 pa.array([None if s is None else hashlib.sha256(b" ".join(s)).hexdigest() for s in split], pa.string())],
                names=["doc_id", "id", "key", "none", "body", "at", "n_words", "sha"])

    kind = dict(rows.dtypes)["doc_id"]
    types = f"doc_id {kind}, id long, key long, none boolean, body string, at binary, n_words long, sha string"
    mark = F.when(F.col("sha").isNull(), F.xxhash64("body"))
    split = met.select("doc_id", "id", "key", "none", "body", "at").mapInArrow(plain, types)
    split = stage(split.withColumn("mark", mark).withColumn("body", F.when(F.col("sha").isNull(), F.col("body"))), "met")
    open_ = split.filter("sha is null")
    flagged = stage(repeats(open_, block, window, buckets), "repeats").withColumnRenamed("at", "windows")
    last = open_.select("doc_id", "key", "none", "mark", "body").join(flagged, ["key", "none", "mark"], "left")

    def remove(batches):
        for batch in batches:
            out = []
            for t, places in zip(texts_of(batch.column(1)), batch.column(2).to_pylist()):
                words = t.split()
                gone = covered_words(len(words), places or b"", window)
                out.append((len(words), int(gone.sum()),
                            hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist()) if not g])).hexdigest()))
            columns = list(zip(*out)) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(
                columns, (pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    done = last.select("doc_id", "body", "windows").mapInArrow(
        remove, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")
    whole = split.filter("sha is not null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"),
                                                   F.col("sha").alias("kept_sha256"))
    return whole.unionByName(done)


def op2_substrings(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM wins) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hits, range(13) t(k)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
         FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
