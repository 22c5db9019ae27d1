"""Descriptors computed from pixels: bit hashes, edge histogram, window vectors.

Images arrive as decoded grey pixels; Spark partitions them and each Arrow batch is
described with numpy.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


# fixed values: descriptor geometry
DCT_SIDE, HASH_SIDE, DIFF_SIDE = 32, 8, 16
EDGE_GRID, EDGE_BINS, EDGE_CELL = 8, 8, 16
BORDER_TOLERANCE, SMALLEST_CROP = 12, 8
PATCH_GRID, WINDOW_SCALES, BLANK_STD = 32, ((16, 8), (8, 4)), 0.05

_SCHEMA = "image_key long, phash long, dhash array<long>, edge array<float>"


def _lanczos(size_in: int, size_out: int) -> np.ndarray:
    """Resampling weights (out x in): three-lobed windowed sinc, widened to shrink."""
    scale = size_in / size_out
    stretch = max(scale, 1.0)
    centers = (np.arange(size_out) + 0.5) * scale
    offsets = (np.arange(size_in)[None, :] + 0.5 - centers[:, None]) / stretch
    weights = np.where(np.abs(offsets) < 3, np.sinc(offsets) * np.sinc(offsets / 3), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def resize(grey: np.ndarray, width: int, height: int) -> np.ndarray:
    rows, cols = _lanczos(grey.shape[0], height), _lanczos(grey.shape[1], width)
    return np.clip(np.rint(rows @ grey.astype(np.float64) @ cols.T), 0, 255)


def normalise(grey: np.ndarray) -> np.ndarray:
    """Cut uniform borders and stretch the contrast to the full range."""
    border = np.concatenate([grey[0], grey[-1], grey[:, 0], grey[:, -1]])
    ink = np.abs(grey.astype(np.float64) - np.median(border)) > BORDER_TOLERANCE
    rows, cols = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
    if rows.size and np.ptp(rows) + 1 >= SMALLEST_CROP and np.ptp(cols) + 1 >= SMALLEST_CROP:
        grey = grey[rows[0]:rows[-1] + 1, cols[0]:cols[-1] + 1]
    low, span = float(grey.min()), float(np.ptp(grey))
    return np.floor((grey - low) * (255.0 / span)) if span > 1 else grey.astype(np.float64)


def _words(bits: np.ndarray) -> list[int]:
    """Booleans -> signed 64-bit words, first bit highest."""
    packed = np.packbits(bits.ravel().astype(np.uint8))
    return [int(w) for w in packed.view(">u8").astype(np.uint64).view(np.int64)]


def perceptual_hash(grey: np.ndarray) -> int:
    """64 bits: low-frequency cosine coefficients above their median."""
    k, x = np.meshgrid(np.arange(HASH_SIDE), np.arange(DCT_SIDE), indexing="ij")
    basis = np.cos(np.pi * (2 * x + 1) * k / (2 * DCT_SIDE)) * np.sqrt(np.where(k == 0, 1, 2) / DCT_SIDE)
    block = basis @ resize(grey, DCT_SIDE, DCT_SIDE) @ basis.T
    block[0, 0] = 0.0
    return _words(block > np.median(block))[0]


def difference_hash(grey: np.ndarray) -> list[int]:
    """256 bits: each pixel brighter than its left neighbour."""
    return _words(np.diff(resize(grey, DIFF_SIDE + 1, DIFF_SIDE), axis=1) > 0)


def edge_histogram(grey: np.ndarray) -> np.ndarray:
    """Unit vector of gradient strength by cell and unsigned orientation."""
    side = EDGE_GRID * EDGE_CELL
    down, across = np.gradient(resize(grey, side, side))
    turn = np.mod(np.arctan2(down, across), np.pi) / np.pi
    bins = np.minimum((turn * EDGE_BINS).astype(int), EDGE_BINS - 1)
    cell = np.arange(side) // EDGE_CELL
    slot = (cell[:, None] * EDGE_GRID + cell[None, :]) * EDGE_BINS + bins
    total = np.bincount(slot.ravel(), weights=np.hypot(across, down).ravel(), minlength=EDGE_GRID ** 2 * EDGE_BINS)
    norm = np.linalg.norm(total)
    return (total / norm if norm > 0 else total).astype(np.float32)


def _describe_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, width, height, pixels in zip(batch["image_key"], batch["width"], batch["height"], batch["pixels"]):
            if pixels is None or len(pixels) != width * height or width * height == 0:
                rows.append((key, None, None, None))
                continue
            grey = normalise(np.asarray(pixels, dtype=np.float64).reshape(height, width))
            rows.append((key, perceptual_hash(grey), difference_hash(grey), edge_histogram(grey)))
        yield pd.DataFrame(rows, columns=["image_key", "phash", "dhash", "edge"])


def describe(images: DataFrame) -> DataFrame:
    """``image_key, phash, dhash[4], edge[512]`` of ``image_key, width, height, pixels``.

    Unreadable images keep a row with null descriptors.
    """
    return images.select("image_key", "width", "height", "pixels").mapInPandas(_describe_batches, _SCHEMA)


# ------------------------------------------------------------------ region windows
def window_grid(grid: int = PATCH_GRID, scales=WINDOW_SCALES) -> list[tuple[int, int, int, int]]:
    """(row0, col0, row1, col1) of the whole grid, then sliding windows per scale."""
    places = [(size, r, c) for size, step in scales
              for r in range(0, grid - size + 1, step) for c in range(0, grid - size + 1, step)]
    return [(0, 0, grid, grid)] + [(r, c, r + size, c + size) for size, r, c in places]


def window_vectors(images: DataFrame, grid: int = PATCH_GRID, scales=WINDOW_SCALES) -> DataFrame:
    """``image_key, window_no, vec``: unit mean vector of the patches in every window.

    ``images`` has ``image_key, patches`` (row-major patch vectors, flattened) and may
    have ``grey`` (one mean brightness list per patch): windows whose brightness varies
    less than the blank limit are dropped, the whole image never.
    """
    windows = window_grid(grid, scales)
    has_grey = "grey" in images.columns

    def pool(batches):
        for batch in batches:
            rows = []
            for i, key in enumerate(batch["image_key"]):
                flat = np.asarray(batch["patches"].iloc[i], dtype=np.float64)
                patches = flat.reshape(grid, grid, -1)
                grey = np.asarray(batch["grey"].iloc[i]).reshape(grid, grid) if has_grey else None
                for no, (r0, c0, r1, c1) in enumerate(windows):
                    if no and grey is not None and grey[r0:r1, c0:c1].std() < BLANK_STD:
                        continue
                    mean = patches[r0:r1, c0:c1].mean(axis=(0, 1))
                    norm = np.linalg.norm(mean)
                    rows.append((key, no, (mean / norm if norm > 0 else mean).astype(np.float32)))
            yield pd.DataFrame(rows, columns=["image_key", "window_no", "vec"])

    columns = ["image_key", "patches"] + (["grey"] if has_grey else [])
    return images.select(*columns).mapInPandas(pool, "image_key long, window_no int, vec array<float>")
