"""Code length of texts under prediction by partial matching, and a unigram base, both learned from the corpus."""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansift.llm.base import Words, mix, slices, table, texts_of
from plansift.llm.classifier import held_out_fold
from plansift.llm.substrings import BUCKET_BYTES
from plansift.staging import stage

#: Bytes of context at most (with the symbol they make a 64-bit code).
ORDER = 7
#: Branches of the trie that hold a smaller share of the corpus's symbols can be cut; the query cuts none.
SHARE = 2.0 ** -21
#: Orders below this are broadcast: over bytes they have at most 2^24 branches, whatever is read.  Longer contexts are dealt
#: to buckets by their last ``LOW`` bytes, so a bucket has all branches of its contexts.
LOW = 3
SPACE, END = 0x20, 0x0A
#: Bytes that no text in UTF-8 has.  One of them opens every word of a document of some class.  The class follows from the
#: text alone; it is coded once, after the end of the document before, then the text given the class: a two-part code.
CLASSES = bytes([0xC0, 0xC1, *range(0xF5, 0x100)])
#: Word hashes are counted by class in so many slots, so what tells classes apart has a fixed size.
SLOTS = 1 << 14
#: Documents that are turned into numpy arrays at a time (their numbers are kept in 16 bits).
SLICE_DOCS = 4096
#: Bytes of text whose different codes are asked for together: the more text, the fewer are new.
SECTION_BYTES = 1 << 23


def _slices(texts):
    for a, b in slices(texts):
        for i in range(a, b, SLICE_DOCS):
            yield i, min(b, i + SLICE_DOCS)


def class_byte(name: str) -> Column:
    """Opening byte for the class in column ``name``; a null class has the space."""
    at = F.pmod(F.shiftright(F.crc32(F.col(name).cast("string").cast("binary")), 16), F.lit(len(CLASSES))).cast("int")
    return F.when(F.col(name).isNull(), F.lit(SPACE)).otherwise(F.element_at(F.array(*[F.lit(b) for b in CLASSES]), at + 1))


@dataclass(frozen=True)
class Classes:
    """Naive Bayes over the words of a text: ``opening`` bytes, their prior and by slot the logarithms of word shares."""
    opening: np.ndarray
    prior: np.ndarray
    logs: np.ndarray

    def of(self, words: Words) -> np.ndarray:
        """Class byte of each document; without words, that of the likeliest class."""
        slot = (words.hash % np.uint64(self.logs.shape[1])).astype(np.int64)
        fit = np.array([p + np.bincount(words.doc, log[slot], len(words.count)) for p, log in zip(self.prior, self.logs)])
        return self.opening[fit.argmax(0)]


ONE_CLASS = Classes(np.array([SPACE], np.uint8), np.zeros(1), np.zeros((1, 1)))


def learn_classes(rows: DataFrame, slots: int = SLOTS) -> Classes:
    """Classes of the texts in column body by their class bytes in column opening; all texts are counted.

    At most (classes x slots) sums come to the driver.
    """
    def run(batches):
        total = np.zeros(256 * slots, np.int64)
        for batch in batches:
            texts, opening = texts_of(batch.column(0)), batch.column(1).to_numpy()
            for a, b in slices(texts):
                words = Words(texts[a:b], lower=True)
                slot = (words.hash % np.uint64(slots)).astype(np.int64)
                total += np.bincount(opening[a:b][words.doc].astype(np.int64) * slots + slot, minlength=256 * slots)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["cell", "n"])

    got = rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(256 * slots)
    counts[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    counts = counts.reshape(256, slots)
    opening = np.flatnonzero(counts.any(axis=1))
    if not len(opening):
        return ONE_CLASS
    counts = counts[opening]
    size = counts.sum(axis=1)
    return Classes(opening.astype(np.uint8), np.log(size / size.sum()), np.log((counts + 0.5) / (size[:, None] + 0.5 * slots)))


def unique_words(words: Words, opening: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, inverse) of the different words of each class; ``opening``: a document's class byte."""
    both = mix(words.hash + opening[words.doc].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(both, return_index=True, return_inverse=True)[1:]


def ends_of(opening: np.ndarray) -> np.ndarray:
    """Codes of what each document has besides its words: its class after an end, and its end after the class."""
    opening = opening.astype(np.uint64)
    return np.concatenate([opening | np.uint64(END << 8), opening << np.uint64(8) | np.uint64(END)])


def symbol_codes(words: Words, which: np.ndarray, opening: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(code, word) for each symbol of the words ``which`` and the space after each.

    A code is the symbol in the lowest byte and the bytes before it in the
    next ones; above the class byte before the word they are zero.
    """
    length = words.end[which] - words.start[which]
    stride = length + order + 1  # zeros, the space before, the word, the space after
    first = np.cumsum(stride) - stride
    data = np.zeros(int(stride.sum()), np.uint8)
    if order:
        data[first + order - 1] = opening[words.doc[which]]
    within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    data[np.repeat(first + order, length) + within] = np.frombuffer(words.data, np.uint8)[np.repeat(words.start[which], length) + within]
    data[first + order + length] = SPACE
    at = np.repeat(first + order, length + 1) + (np.arange(int(length.sum()) + len(which)) - np.repeat(
        np.cumsum(length + 1) - length - 1, length + 1))
    code = np.zeros(len(at), np.uint64)
    for t in range(order + 1):
        code |= data[at - t].astype(np.uint64) << np.uint64(8 * t)
    return code, np.repeat(np.arange(len(which)), length + 1)


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, inverse = np.unique(codes, return_inverse=True)
    return codes, np.bincount(inverse, counts, len(codes)).astype(np.int64)


@dataclass
class Level:
    """Contexts of one order: branches (``code``, ``count``) kept, and by context the total, and sum and number kept.

    ``above``: the part of this order's counts that belongs to symbols kept in the context one byte longer, by that
    context (set on the longer order's level).
    """
    code: np.ndarray
    count: np.ndarray
    context: np.ndarray
    total: np.ndarray
    kept: np.ndarray
    kinds: np.ndarray
    above: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Trie:
    """Context trie of bytes.

    A context codes a kept symbol by (count - 1/2) / total; the rest, half a
    count for each kind kept and all that was cut, escapes to the context one
    byte shorter, where the symbols kept before are excluded.  Below the empty
    context all bytes left are equally likely.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], least: int = 1):
        """``levels`` by order from 0: sorted codes and counts of branches kept, sorted contexts and their totals; branches and
        contexts under ``least`` were cut."""
        self.levels, self.least = [], least
        for order, (code, count, context, total) in enumerate(levels):
            at, _ = _find(context, code >> np.uint64(8))
            size = len(context)
            level = Level(code, count, context, total, np.bincount(at, count, size) if len(code) else np.zeros(size),
                          np.bincount(at, minlength=size) if len(code) else np.zeros(size))
            if order and len(code):
                below = self.levels[-1]
                mask = np.uint64((1 << (8 * order)) - 1)
                shorter, there = _find(below.code, code & mask)
                level.above = np.bincount(at, np.where(there, below.count[shorter] if len(below.code) else 0, 0), size)
            else:
                level.above = np.zeros(size)
            self.levels.append(level)

    def deepened(self, order: int, code: np.ndarray, count: np.ndarray) -> Trie:
        """This trie with longer contexts up to ``order``, from all ``code`` of some of these contexts and their counts."""
        higher, counts = [], count
        for k in range(order, len(self.levels) - 1, -1):
            code, counts = _summed(code & np.uint64((1 << (8 * k + 8)) - 1), counts)
            context, total = _summed(code >> np.uint64(8), counts)
            some, large = counts >= self.least, total >= self.least
            higher.append((code[some], counts[some].astype(np.float64), context[large], total[large].astype(np.float64)))
        return Trie([(v.code, v.count, v.context, v.total) for v in self.levels] + higher[::-1], self.least)

    def branches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each code and total of its context where the longest context keeps it, else zeros."""
        level = self.levels[-1]
        context, there = _find(level.context, codes >> np.uint64(8))
        branch, found = _find(level.code, codes)
        found &= there
        count, total = np.zeros((2, len(codes)), np.uint64)
        count[found], total[found] = level.count[branch[found]], level.total[context[found]]
        return count, total

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """log10 of the probability of each code's symbol after its context."""
        out = np.zeros(len(codes))
        gone, kinds_gone = np.zeros(len(codes)), np.zeros(len(codes))  # excluded counts and kinds at the order at hand
        open_ = np.arange(len(codes))
        for order in range(len(self.levels) - 1, -1, -1):
            level = self.levels[order]
            code = codes[open_] & np.uint64((1 << (8 * order + 8)) - 1)
            context, there = _find(level.context, code >> np.uint64(8))
            branch, found = _find(level.code, code)
            found &= there
            total = np.where(there, level.total[context] if len(level.context) else 0, 0) - gone[open_]
            kept = np.where(there, level.kept[context] if len(level.context) else 0, 0) - gone[open_]
            kinds = np.where(there, level.kinds[context] if len(level.context) else 0, 0) - kinds_gone[open_]
            there &= total > 0  # nothing left here: pass without cost
            parts = np.where(there, total, 1)
            share = np.where(found, level.count[branch] - 0.5 if len(level.code) else 0, total - kept + kinds / 2)
            with np.errstate(divide="ignore"):
                out[open_] += np.where(there, np.log10(share / parts), 0)
            if order and len(level.context):
                seen = _find(level.context, code >> np.uint64(8))[1]
                gone[open_] = np.where(seen, level.above[context], 0)
                kinds_gone[open_] = np.where(seen, level.kinds[context], 0)
            elif order:
                gone[open_] = kinds_gone[open_] = 0
            open_ = open_[~found]
        if len(open_):
            last = self.levels[0]
            left = 256 - (last.kinds[0] if len(last.kinds) else 0)
            out[open_] -= np.log10(max(left, 1))
        return out


def text_codes(words: Words, opening: np.ndarray, order: int = ORDER, across: bool = True,
               near: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(code, document) for each symbol of the texts, with their classes and ends.

    ``across``: contexts run over the words before, back to the end of the
    document before; there the class byte stands for each space passed.
    Otherwise they stop at the opening of the word.
    ``near``: codes are turned.
    """
    if not across:
        code, word = symbol_codes(words, np.arange(len(words.hash)), opening, order)
        ends = ends_of(opening) & np.uint64((1 << (8 * order + 8)) - 1)
        code = np.append(code, ends)
        return turned(code) if near else code, np.append(words.doc[word], np.tile(np.arange(len(opening)), 2))
    docs = len(opening)
    length = words.end - words.start
    size = np.bincount(words.doc, length + 1, docs).astype(np.int64)
    stride = size + order + 2  # zeros and the end before, the class, words with the space after each, the end
    first = np.cumsum(stride) - stride
    data = np.zeros(int(stride.sum()), np.uint8)
    is_symbol = np.ones(len(data), bool)
    is_symbol[(first[:, None] + np.arange(order)).ravel()] = False
    if order:
        data[first + order - 1] = END
    data[first + order], data[first + stride - 1] = opening, END
    run = np.cumsum(length + 1) - length - 1
    start = run + (first + order + 1 - (np.cumsum(size) - size))[words.doc]
    data[start + length] = opening[words.doc]
    taken, placed = np.zeros(len(words.data) + 1, np.int8), np.zeros(len(data) + 1, np.int8)  # bytes of words, there and here
    for marks, here in ((taken, words.start), (placed, start)):
        marks[here] += 1
        marks[here + length] -= 1
    data[np.cumsum(placed[:-1], dtype=np.int8).view(bool)] = np.frombuffer(words.data, np.uint8)[
        np.cumsum(taken[:-1], dtype=np.int8).view(bool)]
    symbol = data.copy()
    symbol[start + length] = SPACE
    before = np.concatenate([np.zeros(7 + near, np.uint8), data])
    code = np.empty(len(data), np.uint64)
    for r in range(8):  # the eight bytes up to each place (turned: before it), read as one number
        code[r::8] = np.frombuffer(before, "<u8" if near else ">u8", len(code[r::8]), r)
    code &= np.uint64((1 << 64) - (1 << (64 - 8 * order)) if near else (1 << (8 * order + 8)) - 256)
    code |= symbol
    return code[is_symbol], np.repeat(np.arange(docs), size + 2)


def turned(codes: np.ndarray) -> np.ndarray:
    """Codes with the nearest byte of the context first, or back; the symbol stays last."""
    return np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 8)[:, [0, 7, 6, 5, 4, 3, 2, 1]]).view(np.uint64).reshape(-1)


def code_buckets(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each turned code, by the last ``LOW`` bytes of its context."""
    return (mix(codes >> np.uint64(8 * (8 - LOW))) % np.uint64(buckets)).astype(np.int64)


def word_buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def by_bucket(bucket: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Places of each bucket's elements, in their order."""
    by = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    return np.split(by, np.cumsum(np.bincount(bucket, minlength=buckets))[:-1])


def pack_codes(codes: np.ndarray) -> bytes:
    """Whole numbers by their bytes of each place, compressed: the upper ones, if sorted or small, come in runs."""
    planes = np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 8).T)
    return len(codes).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unpack_codes(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.Codec("zstd").decompress(data[8:], 8 * n, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view(np.uint64).reshape(n)


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def count_symbols(rows: DataFrame, classes: Classes, order: int, buckets: int, across: bool = False) -> DataFrame:
    """(code, n): how often each symbol follows each context of ``order`` bytes in the training texts (body)."""
    def run(batches):
        codes, counts, held = [], [], 0
        for batch in batches:
            texts = texts_of(batch.column(0))
            for a, b in _slices(texts):
                words = Words(texts[a:b], lower=True)
                opening = classes.of(words)
                if across:
                    code, n = np.unique(text_codes(words, opening, order)[0], return_counts=True)
                else:
                    first, inverse = unique_words(words, opening)
                    code, word = symbol_codes(words, first, opening, order)
                    ends = ends_of(opening) & np.uint64((1 << (8 * order + 8)) - 1)
                    n = np.bincount(inverse, minlength=len(first))
                    code, n = _summed(np.append(code, ends), np.append(n[word], np.ones(len(ends), np.int64)))
                codes.append(code)
                counts.append(n)
                held += len(code)
                if held > 3_000_000:
                    both = _summed(np.concatenate(codes), np.concatenate(counts))
                    codes, counts, held = [both[0]], [both[1]], 0
        if not codes:
            return
        code, n = _summed(np.concatenate(codes), np.concatenate(counts))
        bucket = (mix(code) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
        parts = [by[edges[b]:edges[b + 1]] for b in range(buckets)]
        some = [b for b in range(buckets) if len(parts[b])]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([code[parts[b]].tobytes() for b in some], pa.binary()),
                                          pa.array([n[parts[b]].tobytes() for b in some], pa.binary())], names=["bucket", "codes", "counts"])

    def add(key, part):
        code, n = _summed(*(np.frombuffer(b"".join(part.column(c).to_pylist()), k) for c, k in (("codes", np.uint64), ("counts", np.int64))))
        return pa.table({"code": pa.array(code.view(np.int64)), "n": pa.array(n)})

    return rows.mapInArrow(run, "bucket int, codes binary, counts binary").groupBy("bucket").applyInArrow(add, "code long, n long")


def least_count(total: int, share: float) -> int:
    """Smallest count of a branch that stays: 1 for a ``share`` of zero."""
    return max(2, int(np.ceil(total * share))) if share else 1


def learn(rows: DataFrame, classes: Classes = ONE_CLASS, order: int = ORDER, share: float = SHARE, buckets: int = 8,
          across: bool = False) -> Trie:
    """Trie of the texts in column body.  All texts are counted; branches under ``share`` of all symbols are cut."""
    now = stage(count_symbols(rows, classes, order, buckets, across), "symbols")
    total = now.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = least_count(total, share)
    levels = []
    for k in range(order, -1, -1):
        if k < order:
            now = stage(now.groupBy(F.col("code").bitwiseAND((1 << (8 * k + 8)) - 1).alias("code")).agg(F.sum("n").alias("n")), "symbols")
        pair = []
        for df in (now, now.groupBy(F.shiftrightunsigned("code", 8).alias("code")).agg(F.sum("n").alias("n"))):
            got = df.filter(F.col("n") >= least).toArrow()
            code, n = (got.column(c).to_numpy().astype(t) for c, t in (("code", np.uint64), ("n", np.float64)))
            by = np.argsort(code)
            pair += [code[by], n[by]]
        levels.append(tuple(pair))
    return Trie(levels[::-1], least)


def kinds_of(codes: list[np.ndarray]) -> np.ndarray:
    """Different codes, sorted."""
    code = np.concatenate([np.zeros(0, np.uint64), *codes])
    code.sort()
    new = np.ones(len(code), bool)
    np.not_equal(code[1:], code[:-1], out=new[1:])
    return code[new]


def counted(learnt: list[np.ndarray], held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different codes of both and how often each comes among the learnt ones."""
    some, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *learnt]), return_counts=True)
    kinds = kinds_of([some, *held])
    counts = np.zeros(len(kinds), np.int64)
    counts[np.searchsorted(kinds, some)] = n
    return kinds, counts


_ASKED = "bucket int, section string, codes binary, code_counts binary, hashes binary, hash_counts binary, home binary"
_TOLD = "bucket int, section string, home binary, times binary, others binary, logs binary, counts binary, words long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], names=list(names))


def score_texts(docs: DataFrame, order: int = ORDER, share: float = SHARE, folds: int = 5, by: str | None = "lang",
                across: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Null and empty texts are their end alone.  Rows without id are learned
    from.  Repeated rows count as often as they come.
    ``by``: column of the training rows that names classes, whose words are
    then told apart at their start; every text's own class, in training and
    scoring, is inferred from its words, so equal texts get equal scores.
    ``across``: contexts run over the words before, else over the own word.

    Passes: one counts words by class, one symbols after contexts under
    ``LOW`` bytes, one asks buckets, which know all counts of a word and of a
    context, about the different words, as hashes, and symbol codes of each
    section of neighbouring documents.  A section's compressed texts travel
    along and meet the answers, where its sums are taken.  No vocabulary,
    longer context or text is sent to the driver or broadcast.
    """
    train = F.coalesce(held_out_fold("doc_id", folds) != 1, F.lit(True))
    rows = docs.select(F.col("doc_id"), train.alias("learns"), F.coalesce(F.col("text"), F.lit("")).alias("body"),
                       (class_byte(by) if by else F.lit(SPACE)).alias("opening"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    taught = rows.filter("learns").select("body", "opening")
    classes = learn_classes(taught) if by else ONE_CLASS
    trie = learn(taught.select("body"), classes, min(order, LOW - 1), share, buckets, across)
    model = docs.sparkSession.sparkContext.broadcast(trie)  # orders under LOW
    kind = dict(rows.dtypes)["doc_id"]

    def ask(batches):
        """Rows of ``_ASKED`` for each section; one row of a section, not always the first bucket's, has its texts."""
        task, number = TaskContext.get().partitionId(), 0
        who, codes, hashes, size = [], ([], []), ([], []), 0

        def section():
            whole = pa.Table.from_batches(who).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as writer:
                writer.write_table(whole)
            (code, n), (word, times) = counted(*codes), counted(*hashes)
            some, more = by_bucket(code_buckets(code, buckets), buckets), by_bucket(word_buckets(word, buckets), buckets)
            full = [k for k in range(buckets) if len(some[k]) or len(more[k])]
            home = full[(task + number) % len(full)]
            return _batch([(k, f"{task}/{number}", pack_codes(code[some[k]]), pack_codes(n[some[k]]), pack_codes(word[more[k]]),
                            pack_codes(times[more[k]]), sink.getvalue().to_pybytes() if k == home else b"") for k in full], _ASKED)

        for batch in batches:
            texts = texts_of(batch.column(2))
            learns = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in _slices(texts):
                words = Words(texts[a:b], lower=True)
                opening = classes.of(words)
                code, doc = text_codes(words, opening, order, across, near=True)
                for parts, kind, of in ((codes, code, doc), (hashes, words.hash, words.doc)):
                    for part, some in zip(parts, (learns[a:b][of], ~learns[a:b][of])):
                        part.append(kind[some])
                who.append(pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(~learns[a:b]), pa.array(opening.astype(np.uint8)),
                     pa.array([t.lower() for t in texts[a:b]], pa.binary())], names=["doc_id", "held_out", "opening", "text"]))
                size += sum(map(len, texts[a:b])) + 64 * (b - a)
                if size >= SECTION_BYTES:
                    yield section()
                    who, codes, hashes, size, number = [], ([], []), ([], []), 0, number + 1
        if who:
            yield section()

    def tell(key, bucket):
        """Counts of the words and codes that each section asked for, in its order; logarithms of codes that need shorter contexts."""
        rows = bucket.to_pylist()

        def summed(codes, counts):
            asked = [unpack_codes(r[codes]) for r in rows]
            kinds, inverse = np.unique(np.concatenate(asked), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([unpack_codes(r[counts]) for r in rows]), len(kinds))
            return kinds, counts.astype(np.int64), np.split(inverse.astype(np.int32), np.cumsum([len(c) for c in asked])[:-1])

        kinds, counts, word_places = summed("hashes", "hash_counts")
        code, n, places = summed("codes", "code_counts")
        code = turned(code)
        trie = model.value.deepened(order, code[n > 0], n[n > 0])
        times, total = trie.branches(code)
        logs = np.zeros(len(code))
        logs[times == 0] = trie.log10(code[times == 0])
        known = int((counts > 0).sum())
        return pa.Table.from_batches([_batch([
            (r["bucket"], r["section"], r["home"], pack_codes(times[place]), pack_codes((total - times)[place]),
             squeeze(logs[place][times[place] == 0].tobytes()), pack_codes(counts[words]), 0 if i else known)
            for i, (r, place, words) in enumerate(zip(rows, places, word_places))], _TOLD)])

    def add_up(key, rows):
        """Sums by document of a section, each text's in the order of its codes: equal texts get equal sums."""
        rows = rows.sort_by("bucket").to_pylist()
        who = pa.ipc.open_stream(next(r["home"] for r in rows if r["home"])).read_all().combine_chunks()
        texts, opening = texts_of(who.column("text").combine_chunks()), who.column("opening").to_numpy()
        parts = []
        for a, b in _slices(texts):
            words = Words(texts[a:b])
            code, doc = text_codes(words, opening[a:b], order, across, near=True)
            parts.append([words.count])
            for kinds, of in ((code, doc), (words.hash, words.doc)):
                by = np.argsort(kinds)
                kinds = kinds[by]
                first = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]])[:len(kinds)])
                parts[-1] += [kinds[first], np.diff(first, append=len(kinds)), of[by].astype(np.uint16)]
        codes, hashes = (kinds_of([p[i] for p in parts]) for i in (1, 4))
        times, others, told = (np.concatenate([unpack_codes(r[c]) for r in rows]) for c in ("times", "others", "counts"))
        found = np.log10((times - 0.5) / np.where(times > 0, times + others, 1), where=times > 0, out=np.zeros(len(times)))
        found[times == 0] = np.concatenate([np.frombuffer(unsqueeze(r["logs"])) for r in rows])
        logs, counts = np.empty(len(codes)), np.empty(len(hashes), np.int64)
        logs[np.concatenate(by_bucket(code_buckets(codes, buckets), buckets))] = found
        counts[np.concatenate(by_bucket(word_buckets(hashes, buckets), buckets))] = told
        sums = []
        for n, code, times, doc, word, word_times, of in parts:
            docs = len(n)
            here = np.repeat(counts[np.searchsorted(hashes, word)], word_times)
            sums.append((n + 1, np.bincount(doc, np.repeat(logs[np.searchsorted(codes, code)], times), docs).astype(np.float64),
                         np.bincount(of, np.log10(here + 0.5), docs).astype(np.float64), np.bincount(of, here > 0, docs).astype(np.int64)))
        first = np.zeros(len(texts), np.int64)
        first[0] = sum(r["words"] for r in rows)
        out = who.select(["doc_id", "held_out"])
        for name, column in zip(("n_tokens", "score", "logs", "known", "words"), (*map(np.concatenate, zip(*sums)), first)):
            out = out.append_column(name, pa.array(column))
        return out

    asked = rows.select("doc_id", "learns", "body").mapInArrow(ask, _ASKED)
    done = asked.groupBy("bucket").applyInArrow(tell, _TOLD).groupBy("section").applyInArrow(
        add_up, f"doc_id {kind}, held_out boolean, n_tokens long, score double, logs double, known long, words long")
    done = stage(done, "scored")
    learned = F.when(~F.col("held_out"), 1)
    total, ends, kinds = done.agg(F.coalesce(F.sum(learned * F.col("n_tokens")), F.lit(0)), F.count(learned),
                                  F.coalesce(F.sum("words"), F.lit(0))).first()
    kinds += ends > 0
    base = F.col("logs") + float(np.log10(ends + 0.5)) - F.col("n_tokens") * float(np.log10(total + 0.5 * (kinds + 1)))
    return done.select("doc_id", "held_out", "n_tokens", (F.col("known") + int(ends > 0)).alias("n_known"),
                       F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op10_lm_scoring(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"), share=0, across=True)
