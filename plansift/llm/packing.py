"""Best-two-fit packing of token sequences."""
from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.llm.base import fresh, number_within, table, texts_of
from plansift.staging import stage

CAPACITY = 4096
TOKENIZER = "word_bpe_49k.json"
#: Written after each document.
END = np.array([1], "<u4").tobytes()
#: Parts of texts whose ids a task remembers before it starts anew (memory only; results do not depend on it).
REMEMBERED, LONGEST = 500_000, 64
_STATE: dict = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


#: In a text of these bytes (ASCII without the apostrophe, and Latin-1 letters, whose first byte is C3) the tokenizer's
#: pieces end wherever letters and punctuation meet, so words can be looked up without their commas and capitals.
_PLAIN = bytes(b for b in (*range(9, 14), *range(32, 127), *range(128, 192), 0xC3) if b != 39)
_MARKS = re.compile(rb"[!-/:-@\[-`{-~]+")
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def keys_of(text: bytes) -> list[bytes]:
    """Parts of a text whose ids, joined, are the ids of the text: its words, or runs of letters and of marks."""
    if text.translate(None, _PLAIN) or b"<|" in text or b"\xc3\x97" in text or b"\xc3\xb7" in text:
        return text.split()
    return _MARKS.sub(rb" \g<0> ", text.lower()).split()


def part_ids(parts: set[bytes], path: str) -> dict[bytes, bytes]:
    """Little-endian ids of each part, remembered by the task; the tokenizer never joins ids across white space."""
    if _STATE.get("path") != path:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        last = np.zeros(max(tokenizer.get_vocab().values()) + 1, bool)
        last[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        _STATE.update(path=path, tokenizer=tokenizer, last=last, known={})
    if len(_STATE["known"]) > REMEMBERED:
        _STATE["known"] = {}
    known, tokenizer = _STATE["known"], _STATE["tokenizer"]
    new = [p for p in parts if p not in known]
    letters = [p for p in new if _LETTERS.fullmatch(p)]
    for i in range(0, len(letters), 2048):
        some = letters[i:i + 2048]
        ids = np.array(tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(_STATE["last"][ids]) + 1  # a run of letters is one piece, and ends in a token of a word's end
        if len(ends) != len(some):
            break
        coded, at = ids.tobytes(), 0
        for p, end in zip(some, (4 * ends).tolist()):
            known[p] = coded[at:end]
            at = end
    extra = {}
    rest = [p for p in new if p not in known]
    for i in range(0, len(rest), 4096):
        some = rest[i:i + 4096]
        coded = tokenizer.encode_batch_fast([p.decode() for p in some], add_special_tokens=False)
        for p, c in zip(some, coded):
            (known if len(p) <= LONGEST else extra)[p] = np.array(c.ids, "<u4").tobytes()
    return {**{p: known[p] for p in parts if p in known}, **extra} if extra else known


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, piece, start, length, ids_crc32: each document's ids and one end mark, cut where longer than ``capacity``.

    Null and empty texts are the end mark alone.  One pass, nothing shuffled.
    """
    n, here = len(keep), fresh("body", keep)
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(here))
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:n]]
    types += ["piece int", "start long", "length long", "ids_crc32 long"]

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                some = batch.slice(low, 500)
                split = [keys_of(t) for t in texts_of(some.column(n))]
                ids = part_ids(set().union(*split), path)
                row, piece, start, length, crc = [], [], [], [], []
                for i, parts in enumerate(split):
                    coded = b"".join(map(ids.__getitem__, parts)) + END
                    for k, at in enumerate(range(0, len(coded), 4 * capacity)):
                        part = coded[at:at + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                kept = [some.column(i).take(pa.array(row, pa.int64())) for i in range(n)]
                made = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*keep, "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(run, ", ".join(types))


def _pair(sizes: np.ndarray, counts: np.ndarray, room: int, above: int) -> tuple[int, int] | None:
    """Two available sizes whose sum is the largest that fits ``room``, if it is over ``above``."""
    at = np.searchsorted(sizes, np.minimum(room - sizes, sizes), "right") - 1
    at[(at >= 0) & (sizes[at] == sizes) & (counts < 2)] -= 1
    sums = np.where(at >= 0, sizes + sizes[np.maximum(at, 0)], 0)
    best = int(np.argmax(sums)) if len(sums) else 0
    return (int(sizes[best]), int(sizes[at[best]])) if len(sums) and above < sums[best] <= room else None


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(sizes of a bin, times it is made) by best-two-fit over the numbers of pieces of each size.

    Fill greedily by the largest piece that fits; while two unpacked pieces
    fit the gap that the smallest leaves more tightly, they replace it.  A bin
    is made as often as the pieces allow before the next is planned, so the
    work follows the number of different sizes (``capacity`` at most), not the
    number of pieces.
    """
    left = {s: c for s, c in histogram.items() if c}
    sizes = sorted(left)
    bins = []
    while sizes:
        used: dict[int, int] = {}
        filled, gap = [], capacity

        def free(s):
            return left[s] - used.get(s, 0)

        def take(s, k=1):
            used[s] = used.get(s, 0) + k

        at = len(sizes)
        while gap and (at := bisect_right(sizes, gap, 0, at)):
            s = sizes[at - 1]
            k = min(free(s), gap // s)
            if k:
                filled += [s] * k
                take(s, k)
                gap -= s * k
            at -= 1
        while gap and filled:
            last = filled[-1]
            open_ = np.array([s for s in sizes[:bisect_right(sizes, gap + last)] if free(s)], np.int64)
            two = _pair(open_, np.array([free(int(s)) for s in open_], np.int64), gap + last, last)
            if not two:
                break
            take(last, -1)
            filled.pop()
            for s in two:
                take(s)
                filled.append(s)
            gap += last - sum(two)
            filled.sort(reverse=True)
        used = {s: k for s, k in used.items() if k}
        times = min(left[s] // k for s, k in used.items())
        bins.append((filled, times))
        for s, k in used.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
                del sizes[bisect_right(sizes, s) - 1]
    return bins


def slot_table(bins: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For the r-th piece of a size: which run of equal bins takes it, the first bin, pieces a bin, first offset."""
    rows, taken, sequence = [], {}, 0
    for filled, times in bins:
        offset = 0
        for s in dict.fromkeys(filled):
            k = filled.count(s)
            rows.append((s, taken.get(s, 0), k, sequence, offset))
            taken[s] = taken.get(s, 0) + k * times
            offset += s * k
        sequence += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return {"key": (columns[0] << 46) + columns[1], "first": columns[1], "each": columns[2], "bin": columns[3], "offset": columns[4]}


def pack(parts: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """``parts`` with sequence_id and offset: best-two-fit of all rows by ``length`` (1 to ``capacity``).

    Only the number of rows of each length goes to the driver (``capacity``
    counts at most) and only the runs of equal bins come back.  Rows of one
    length are interchangeable; they are numbered by range partitions, so a
    length that a third of all rows have is spread over many tasks.
    """
    parts = stage(parts.withColumn("row_", F.monotonically_increasing_id()), "pieces")
    counts = {int(r[0]): int(r[1]) for r in parts.groupBy(length).agg(F.count("*")).collect()}
    slots = slot_table(plan_bins(counts, capacity))
    ranked = number_within(parts, [length], ["row_"], "rank_").drop("row_")
    names = [c for c in ranked.columns if c != "rank_"]
    at, n = names.index(length), len(names)
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank_"]

    def run(batches):
        for batch in batches:
            size, rank = (batch.column(i).to_numpy() for i in (at, batch.schema.get_field_index("rank_")))
            slot = np.searchsorted(slots["key"], (size.astype(np.int64) << 46) + rank, "right") - 1
            each = slots["each"][slot]
            bin_, within = np.divmod(rank - slots["first"][slot], each)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(n)), pa.array(slots["bin"][slot] + bin_),
                 pa.array(slots["offset"][slot] + within * size)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank_").mapInArrow(run, ", ".join([*types, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of ``docs``."""
    return pack(pieces(docs, path or tokenizer_path(), capacity), capacity)


def op8_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))
