"""Outside engines as plug-ins, run inside tasks over Arrow batches.

Encoders, text recognisers and key-point matchers are supplied by the caller; each
factory is called once per task, so a model loads once and not per row.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from plansift.functions import text as T

# fixed values: limits of the geometric check
RANSAC_PIXELS, RANSAC_ROUNDS = 6.0, 500

Encoder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
Recogniser = Callable[[str], str]


def page_encoding_text(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """``page_id, content``: what an encoder reads of a page; whole unless ``max_chars`` is the encoder's input limit."""
    head = F.concat_ws(" | ", "title", F.array_join("systems", " "), "doc_kind")
    whole = F.concat_ws("\n", head, T.clean_text(F.col("text")), T.blank_to_empty(F.col("ocr_text")))
    return pages.select("page_id", (whole if max_chars is None else F.substring(whole, 1, max_chars)).alias("content"))


def encode(rows: DataFrame, key: str, content: str, factory: Callable[[], Encoder]) -> DataFrame:
    """``key, vec``: unit vectors of a text column."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        encoder = factory()
        for batch in batches:
            found = np.asarray(encoder(list(batch[content])), dtype=np.float32)
            norms = np.linalg.norm(found, axis=1, keepdims=True)
            unit = found / np.where(norms > 0, norms, 1)
            yield pd.DataFrame({key: batch[key], "vec": list(unit)})

    return rows.select(key, content).mapInPandas(run, f"{key} {kind}, vec array<float>")


def recognise(images: DataFrame, factory: Callable[[], Recogniser]) -> DataFrame:
    """``page_id, ocr_text`` of ``images(page_id, image)``; empty results are dropped."""
    def run(batches):
        reader = factory()
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"], "ocr_text": [reader(i) for i in batch["image"]]})

    return images.select("page_id", "image").mapInPandas(run, "page_id long, ocr_text string").filter("ocr_text <> ''")


# ----------------------------------------------------------------- geometric check
def _homography(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Projective map through point pairs (direct linear solution)."""
    rows = []
    for (x, y), (u, v) in zip(a, b):
        rows += [[-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v]]
    solution = np.linalg.svd(np.asarray(rows))[2][-1]
    return solution.reshape(3, 3) if np.isfinite(solution).all() else None


def inlier_count(a: np.ndarray, b: np.ndarray, limit: float = RANSAC_PIXELS) -> int:
    """Largest number of point pairs that agree with one projective map.

    Fewer than four pairs cannot be checked and count as they are.  Samples are drawn
    from a fixed seed, so a retried task gives the same count.
    """
    if len(a) < 4:
        return len(a)
    rng, best = np.random.default_rng(0), 0
    flat = np.column_stack([a, np.ones(len(a))])
    for _ in range(RANSAC_ROUNDS):
        pick = rng.choice(len(a), 4, replace=False)
        h = _homography(a[pick], b[pick])
        if h is None:
            continue
        mapped = flat @ h.T
        with np.errstate(divide="ignore", invalid="ignore"):
            error = np.linalg.norm(mapped[:, :2] / mapped[:, 2:] - b, axis=1)
        best = max(best, int((error <= limit).sum()))
    return best


def verified_inliers(pairs: DataFrame) -> DataFrame:
    """``image_key, inliers`` of ``image_key, ax[], ay[], bx[], by[]`` (matched points).

    Null points mark a pair the matcher could not process: -1.
    """
    def run(batches):
        for batch in batches:
            counts = []
            for ax, ay, bx, by in zip(batch["ax"], batch["ay"], batch["bx"], batch["by"]):
                if ax is None or bx is None:
                    counts.append(-1)
                else:
                    counts.append(inlier_count(np.column_stack([ax, ay]), np.column_stack([bx, by])))
            yield pd.DataFrame({"image_key": batch["image_key"], "inliers": counts})

    return pairs.select("image_key", "ax", "ay", "bx", "by").mapInPandas(run, "image_key long, inliers int")
