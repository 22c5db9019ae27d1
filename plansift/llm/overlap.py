"""Texts that may reach a Jaccard similarity of their shingles: a prefix filter, rarest shingles first."""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansift.llm.base import Words, slices, texts_of
from plansift.staging import stage

#: Shingles are 48-bit hashes here.
_BITS = 48
#: Bytes of text whose shingles are counted in one task, on average.
BUCKET_TEXT = 12 << 20
#: Rows of the sample that finds shingles too frequent to be counted in one task, and the rows of it that must hold such a one.
SAMPLE_ROWS, SAMPLE_HITS = 1 << 12, 4
#: Stands for the frequency of such shingles: they come last.
OFTEN = (1 << 31) - 1


def sets_of(texts: list[bytes], size: int):
    """Set of shingles of each text, lower-cased; with fewer than ``size`` words the text is one shingle."""
    words = Words(texts, lower=True)
    at, found = words.windows(size)
    edges = np.searchsorted(at, words.first)
    for low, high, a, b in zip(edges, edges[1:], words.first, words.first[1:]):
        yield np.unique((found[low:high] if high > low else words.hash[a:b].sum(keepdims=True)) >> np.uint64(64 - _BITS))


def prefix_length(n: int, similarity: float) -> int:
    """So many first elements of a set of ``n``, in an order common to all sets, meet those of each similar set."""
    return n - int(np.ceil(similarity * n - 1e-3)) + 1


def text_id(key: str) -> int:
    return int(key[:15], 16)


def id_column(key: str) -> Column:
    """``text_id`` of the column ``key``."""
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long")


def frequent_shingles(docs: DataFrame, text: str, rows: int, size: int) -> np.ndarray:
    """Sorted shingles that ``SAMPLE_HITS`` or more of about ``SAMPLE_ROWS`` sampled rows hold."""
    def count(batches):
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in slices(texts):
                kinds, n = np.unique(np.concatenate(list(sets_of(texts[a:b], size))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n)], names=["h", "n"])

    some = docs.select(text).sample(min(1.0, SAMPLE_ROWS / max(rows, 1)), seed=1)
    often = some.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= SAMPLE_HITS)
    return np.sort(often.select("h").toArrow().column(0).to_numpy())


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _eight(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view(np.int64)[:, 0]


def _joined(column: pa.ChunkedArray) -> memoryview | bytes:
    """All bytes of a binary column, in its own buffer where it has one chunk."""
    def part(chunk):
        ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset:chunk.offset + len(chunk) + 1]
        return memoryview(chunk.buffers()[2])[ends[0]:ends[-1]] if chunk.buffers()[2] else b""
    parts = [part(c) for c in column.chunks if len(c)]
    return parts[0] if len(parts) == 1 else b"".join(parts)


def repeated_shingles(docs: DataFrame, text: str, similarity: float, size: int) -> DataFrame:
    """Rows (id, h, freq) of each different text: its shingles that other texts hold too, and one with its counts.

    freq > 0: number of texts with shingle ``h``, or ``OFTEN``; freq < 0: h is
    the number of shingles of the text, -freq - 1 of them are frequent and not
    listed, since the text's other shingles fill its prefix.  Frequent ones go
    to no common bucket, so one shared by a third of all texts meets nowhere.
    """
    rows, total = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    often, buckets = frequent_shingles(docs, text, rows, size), 1 + total // BUCKET_TEXT

    def deal(batches):
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in slices(texts):
                # copies within a slice are one text
                keys = [hashlib.md5(b" ".join(t.lower().split())).hexdigest() for t in texts[a:b]]
                once = dict(zip(keys, texts[a:b]))
                ids, hashes, own, listed, freqs = [], [], [], [], []
                for key, found in zip(once, sets_of(list(once.values()), size)):
                    found, me = found.view(np.int64), text_id(key)
                    at = np.searchsorted(often, found)
                    hot = np.isin(found, often[at[at < len(often)]], assume_unique=False)
                    rare, n = found[~hot], len(found)
                    need = len(rare) < prefix_length(n, similarity)
                    ids.append(np.full(len(rare), me))
                    hashes.append(rare)
                    more = found[hot] if need else found[:0]
                    own.append(np.full(1 + len(more), me))
                    listed.append(np.append(n, more))
                    freqs.append(np.append(-1 if need else -1 - int(hot.sum()), np.full(len(more), OFTEN)))
                ids, hashes = np.concatenate(ids), np.concatenate(hashes)
                bucket = hashes % buckets
                order = np.argsort(bucket, kind="stable")  # by text inside a bucket, which compresses
                edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                rows = [(int(bucket[order[i]]), ids[order[i:j]].tobytes(), _six(hashes[order[i:j]]), None)
                        for i, j in zip(edges, [*edges[1:], len(order)])]
                own, listed, freqs = (np.concatenate(x).astype(np.int64) for x in (own, listed, freqs))
                rows.append((int(own[0] % buckets), own.tobytes(), listed.tobytes(), freqs.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 3))],
                                                 names=["bucket", "ids", "hashes", "freqs"])

    def count(key, rows):
        plain = pa.compute.is_null(rows.column("freqs"))
        counted, passed = rows.filter(plain), rows.filter(pa.compute.invert(plain))
        del rows
        ids, h = np.frombuffer(_joined(counted.column("ids")), np.int64), _eight(_joined(counted.column("hashes")))
        del counted
        order = np.argsort(ids, kind="stable")
        order = order[np.argsort(h[order], kind="stable")]
        ids, h = ids[order], h[order]
        del order
        once = np.append(True, (np.diff(ids) != 0) | (np.diff(h) != 0))[:len(h)]  # copies come from several slices
        ids, h = ids[once], h[once]
        start = np.flatnonzero(np.append(True, np.diff(h) != 0)[:len(h)])
        n = np.diff(np.append(start, len(h)))  # texts with each shingle
        n = np.repeat(n, n)
        own, listed, freqs = (np.frombuffer(_joined(passed.column(c)), np.int64) for c in ("ids", "hashes", "freqs"))
        made = [(ids[n > 1], own), (h[n > 1], listed), (n[n > 1], freqs)]
        return pa.table({c: np.concatenate(x).astype(np.int64) for c, x in zip(("id", "h", "freq"), made)})

    return (docs.select(text).mapInArrow(deal, "bucket long, ids binary, hashes binary, freqs binary")
            .groupBy("bucket").applyInArrow(count, "id long, h long, freq long"))


def prefix_links(docs: DataFrame, text: str, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """(a, b): edges between texts (``text_id`` of their words' MD5) that join every pair of ``similarity`` or more.

    Complete: all sets of shingles are put into one order (held by one text
    only, then by frequency, the most frequent by hash), in which similar sets
    share one of their first ``prefix_length`` elements.  Shingles of one text
    cannot be shared, so a text with that many of them takes no part.  Those
    that do are linked with the smallest id of the same shingle and a like
    size, so a hot shingle gives as many edges as texts, not pairs.  Pairs
    below ``similarity`` are linked as well: the edges are candidates.
    """
    found = repeated_shingles(docs, text, similarity, size)
    listed = found.groupBy("id").agg(F.collect_set(F.struct("freq", "h")).alias("all"))
    head = F.filter("all", lambda x: x["freq"] < 0)[0]
    n, skipped = head["h"], -head["freq"] - 1
    shared = F.sort_array(F.filter("all", lambda x: x["freq"] > 0))
    alone = n - skipped - F.size(shared)
    take = n - F.ceil(F.lit(similarity) * n - 1e-3) + 1 - alone
    width = max(-float(np.log(similarity)), 1e-3) * 1.001
    band = F.floor(F.log(n.cast("double")) / width)
    prefix = listed.filter(take > 0).select("id", band.alias("band"), F.explode(
        F.slice(shared, F.lit(1), take.cast("int"))["h"]).alias("h"))
    prefix = prefix.select("id", "h", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    prefix = stage(prefix, "prefixes")
    least = prefix.groupBy("h", "band").agg(F.min("id").alias("b"), F.max("id").alias("most")).filter("b < most")
    return prefix.join(least, ["h", "band"]).filter("id <> b").select(F.col("id").alias("a"), "b").distinct()
