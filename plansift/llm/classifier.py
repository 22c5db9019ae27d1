"""Quality of texts: document statistics, random Fourier features, ridge by summed normal equations, isotonic calibration."""
from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plansift.llm.base import fresh, table
from plansift.staging import stage

FEATURES = ("words", "word_length", "symbols", "upper", "digits", "shouts", "bars", "marks", "different_words", "same_as_before",
            "same_lines", "line_words", "closed_lines", "beyond_ascii", "top_word", "different_windows", "longest_word", "lines")
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOLS, _MARKS = b"#*$%&|<>", b".,;:?'\"()-"
_CLOSING = (b".", b"!", b"?", b'"', b":", b")")


def statistics(text: bytes) -> list[float]:
    """The values of ``FEATURES``; zeros for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)

    def share(of: bytes) -> float:
        return (len(text) - len(text.translate(None, of))) / len(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    kinds = set(words)
    windows = set(zip(words, words[1:], words[2:]))
    return [np.log1p(n), sum(map(len, words)) / n, share(_SYMBOLS), share(_UPPER), share(_DIGIT), text.count(b"!") / n,
            text.count(b"|") / n, share(_MARKS), len(kinds) / n ** 0.5, sum(map(bytes.__eq__, words, words[1:])) / n,
            1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(x.rstrip().endswith(_CLOSING) for x in lines) / len(lines),
            1 - len(text.decode("utf-8", "replace")) / len(text), Counter(words).most_common(1)[0][1] / n,
            len(windows) / max(1, n - 2), np.log1p(max(map(len, words))), np.log1p(len(lines))]


@dataclass(frozen=True)
class Kernel:
    """``features``: random features.  ``width``: of the Gaussian, in standardised units a statistic.  ``ridge``: per row."""
    features: int = 160
    width: float = 1.0
    ridge: float = 1e-3
    seed: int = 42
    #: Raw scores are counted on a grid of so many steps a unit for the calibration.
    grid: int = 500


def held_out_fold(key: str = "doc_id", folds: int = 5) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)).cast("int")


def measure(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    n, here = len(keep), fresh("body", keep)
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).cast("binary").alias(here))
    types = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:n]] + ["x array<double>"])

    def run(batches):
        for batch in batches:
            x = [statistics(t) for t in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(x, pa.list_(pa.float64()))],
                                             names=[*keep, "x"])

    return source.mapInArrow(run, types)


class Model:
    """Standardisation, random features, ridge weights and the calibration curve: sizes do not depend on the corpus."""

    def __init__(self, mean, deviation, how: Kernel):
        rng, d = np.random.default_rng(how.seed), len(FEATURES)
        self.mean, self.deviation = np.array(mean), np.where(np.array(deviation) > 1e-12, deviation, 1.0)
        self.direction = rng.standard_normal((d, how.features)) / (how.width * np.sqrt(d))
        self.phase = rng.uniform(0, 2 * np.pi, how.features)
        self.weights = np.zeros(how.features + 1)
        self.curve = (np.array([0.0]), np.array([0.5]))

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        z = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.direction + self.phase)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.curve)


def isotonic(at: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising curve through shares of ones by pooling of neighbours that fall; points are the pools' means."""
    pools: list[list[float]] = []
    for x, y, w in zip(at, ones, n):
        pools.append([x * w, y, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _rows(batch, column: int) -> np.ndarray:
    return np.array(batch.column(column).to_pylist(), np.float64).reshape(batch.num_rows, len(FEATURES))


def train(measured: DataFrame, labelled: DataFrame, how: Kernel = Kernel()) -> Model:
    """``measured``: x of all documents, for the standardisation; ``labelled``: x, y (0 or 1) and ``calibrate``.

    Normal equations are added up by partition and then by entry; their size
    is fixed by the number of random features.
    """
    d = len(FEATURES)
    stats = measured.agg(*[f(F.col("x")[i]).alias(f"{f.__name__}{i}") for f in (F.avg, F.stddev_pop) for i in range(d)]).first()
    model = Model([v or 0.0 for v in stats[:d]], [v or 0.0 for v in stats[d:]], how)
    size = how.features + 2  # random features, the constant, the label

    def add(batches):
        total = np.zeros((size, size))
        for batch in batches:
            z = np.hstack([model.expand(_rows(batch, 0)), batch.column(1).to_numpy().astype(np.float64)[:, None]])
            total += z.T @ z
        upper = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(upper[0] * size + upper[1]), pa.array(total[upper])], names=["entry", "value"])

    sums = labelled.filter("not calibrate").select("x", "y").mapInArrow(add, "entry long, value double")
    full = np.zeros((size, size))
    for entry, value in sums.groupBy("entry").agg(F.sum("value")).collect():
        full[divmod(entry, size)] = value
    full += np.triu(full, 1).T
    a, b, n = full[:-1, :-1], full[:-1, -1], full[-2, -2]
    if not n:
        return model
    model.weights = np.linalg.solve(a + how.ridge * n * np.eye(len(a)), b)

    def place(batches):
        for batch in batches:
            bins = np.rint(np.clip(model.raw(_rows(batch, 0)), -2, 3) * how.grid).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], names=["bin", "y"])

    placed = labelled.filter("calibrate").select("x", "y").mapInArrow(place, "bin long, y int")
    bins = np.array(sorted(placed.groupBy("bin").agg(F.sum("y"), F.count("*")).collect()), np.float64)
    if len(bins):
        model.curve = isotonic(bins[:, 0] / how.grid, bins[:, 1], bins[:, 2])
    return model


def score_documents(docs: DataFrame, labels: DataFrame, how: Kernel = Kernel(), threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Labels count where the id's fold is not 0 and ``quality`` is 0 or 1; fold 1
    calibrates, the others fit.  Null and empty texts are scored by statistics
    of zero.  Without labels every score is 0.5.  Rows without id are scored
    and teach nothing.  Statistics of texts are the only inputs of a score.
    """
    measured = stage(measure(docs, "text", ["doc_id"]).withColumn("fold", held_out_fold("doc_id", folds)), "measured")
    known = labels.filter("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("y"))
    labelled = stage(measured.filter("fold <> 0").join(known, "doc_id").select("x", "y", (F.col("fold") == 1).alias("calibrate")), "labelled")
    model = train(measured, labelled, how)
    kind = dict(measured.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            score = np.clip(model.score(_rows(batch, 2)), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score),
                                              pa.array((score >= threshold).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.col("fold") == 0, F.lit(False)).alias("held_out")
    return measured.select("doc_id", held, "x").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op9_classifier(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
