"""Figures, highlight boxes and page geometry."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plansift.functions import vectors as X
from plansift.operators.relational import BROADCAST_ROWS, broadcast_within, rows_up_to, top_per_key

MEDIA_ROOT = "/media/"
FIGURES_PER_PAGE, FIGURE_LIMIT, MARK_LIMIT = 4, 12, 60


def figures_for_pages(ranked: DataFrame, figures: DataFrame, limit: int = FIGURE_LIMIT,
                      per_page: int = FIGURES_PER_PAGE) -> DataFrame:
    """Drawings first, then the largest, at most ``per_page`` of each ranked page.

    ``ranked`` has ``qid, page_id, rank`` (one result list per question); it is the
    small side, so the figure table is filtered where it lies.
    """
    wanted = ranked.select("qid", "page_id", F.col("rank").alias("page_rank"))
    wanted = broadcast_within(wanted, rows_up_to(wanted, BROADCAST_ROWS))
    rows = figures.join(wanted, "page_id")
    drawing_first = F.when(F.col("kind") == "drawing", 0).otherwise(1)
    best = top_per_key(rows, ["qid", "page_id"], [drawing_first, F.desc("area"), F.asc("figure_id")],
                       per_page, rank="on_page")
    top = top_per_key(best, ["qid"], [F.asc("page_rank"), F.asc("on_page")], limit)
    return top.withColumn("url", F.concat(F.lit(MEDIA_ROOT), "filename")).withColumn(
        "thumb_url", F.concat(F.lit(MEDIA_ROOT), F.coalesce(F.nullif("thumb", F.lit("")), F.col("filename"))))


def ocr_highlights(boxes: DataFrame, asked: DataFrame, budget: int = MARK_LIMIT) -> DataFrame:
    """Recognised text boxes of the ranked pages that contain a term.

    ``asked`` has ``qid, page_id, terms``; terms under three characters are ignored
    and each page keeps at most ``budget`` boxes in reading order.
    """
    asked = broadcast_within(asked, rows_up_to(asked, BROADCAST_ROWS))
    hay = F.lower("text")
    usable = F.filter("terms", lambda t: F.length(t) > 2)
    hits = boxes.join(asked, "page_id").filter(
        F.exists(usable, lambda t: F.contains(hay, F.lower(t))))
    return top_per_key(hits, ["qid", "page_id"], [F.asc("box_id")], budget, rank="mark")


def marks_in_figures(marks: DataFrame, figures: DataFrame, min_overlap: float = X.MARK_OVERLAP) -> DataFrame:
    """Highlight boxes re-expressed inside the figures cut from the same page.

    ``marks`` has ``page_id, mark(x,y,w,h)``; ``figures`` has ``page_id, box``.
    The page is the equality key; the overlap test is the residual condition.
    """
    pairs = marks.join(figures, "page_id")
    placed = pairs.withColumn("placed", X.mark_in_crop(F.col("mark"), F.col("box"), min_overlap))
    return placed.filter("placed is not null")


# ------------------------------------------------------- drawings from pen strokes
# fixed values: occupancy grid and cluster limits (PDF points)
CELL, DILATE, PAD = 6.0, 2, 7.0
MIN_AREA, MAX_AREA, MIN_SIDE, MAX_FIGURES = 0.010, 0.88, 24.0, 8
#: cells of the stack of pages that a task handles at a time (one larger sheet goes alone)
GRID_CELLS = 1 << 21
#: strokes of a page that are compared with each other instead of drawn on its grid
FEW_STROKES = 24
#: strokes of an unfinished page that are kept as they are
STROKES_HELD = 10_000


def stroke_cells(strokes: DataFrame) -> DataFrame:
    """``page_id, width, height, x0, x1, y0, y1``: first and last grid column and row that each stroke box touches.

    ``strokes`` has ``page_id, width, height, x0, y0, x1, y1``; boxes are clipped to
    the page, and boxes over half of the page (borders, tints) do not count.
    """
    s = strokes.filter((F.col("width") > 0) & (F.col("height") > 0))
    s = (s.withColumn("x0", F.greatest("x0", F.lit(0.0))).withColumn("y0", F.greatest("y0", F.lit(0.0)))
         .withColumn("x1", F.least("x1", "width")).withColumn("y1", F.least("y1", "height")))
    s = s.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    s = s.filter((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
                 <= F.lit(0.5) * F.col("width") * F.col("height"))

    def cell(value, extent):
        last = F.floor(F.col(extent) / CELL)
        return F.least(F.floor(F.col(value) / CELL), last).cast("int")

    return s.select("page_id", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"),
                    cell("x0", "width").alias("x0"), cell("x1", "width").alias("x1"),
                    cell("y0", "height").alias("y0"), cell("y1", "height").alias("y1"))


def _words(page: np.ndarray, cells: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    """Grids of a stack of pages in 64-cell words, one bit a cell; ``cells`` are the columns x0, x1, y0, y1 of strokes."""
    pages, height, width = shape
    words = np.zeros((pages * height, -(-width // 64)), np.uint64)
    left, right, top, bottom = cells
    for w in range(words.shape[1]):
        here = np.flatnonzero((left < 64 * (w + 1)) & (right >= 64 * w))
        low, high = np.maximum(left[here] - 64 * w, 0), np.minimum(right[here] - 64 * w, 63)
        mask = (np.uint64(2**64 - 1) << low.astype(np.uint64)) & (np.uint64(2**64 - 1) >> (63 - high).astype(np.uint64))
        n = bottom[here] - top[here] + 1
        at = np.repeat(page[here] * height + top[here] - np.cumsum(n) + n, n) + np.arange(n.sum())
        np.bitwise_or.at(words[:, w], at, np.repeat(mask, n))
    return words.reshape(pages, height, -1)


def _bits(words: np.ndarray, width: int) -> np.ndarray:
    return np.unpackbits(words.astype("<u8").view(np.uint8), axis=2, bitorder="little")[:, :, :width].astype(bool)


def _as_runs(cells: np.ndarray) -> np.ndarray:
    """The strokes of one page as runs of cells: no more than the sheet has, however many strokes there were."""
    high, wide = int(cells[3].max()) + 1, int(cells[1].max()) + 1
    grid = _bits(_words(np.zeros(cells.shape[1], int), cells, (1, high, wide)), wide)[0].astype(np.int8)
    edge = np.diff(grid, axis=1, prepend=0, append=0)
    y, left = np.nonzero(edge == 1)
    return np.stack([left, np.nonzero(edge == -1)[1] - 1, y, y])


def _by_page(batches):
    """(ids, first stroke of each page and the end of the last, width and height of each page, cells) of whole pages.

    Strokes come in order of their pages.  The last page of a batch may go on in the next one, so its strokes
    are kept back, as runs of cells once they are many.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, width, height = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        cells = np.stack([batch.column(i).to_numpy() for i in range(3, 7)]).astype(np.int64)
        code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
        if held is not None:
            old, extent, before = held
            if old.equals(ids.slice(0, 1)):
                cells = np.concatenate([before, cells], axis=1)
                code = np.concatenate([np.full(before.shape[1], code[0]), code])
                width, height = (np.concatenate([np.full(before.shape[1], e), x]) for e, x in zip(extent, (width, height)))
                ids = pa.concat_arrays([pa.nulls(before.shape[1], ids.type), ids])
            else:
                yield old, np.array([0, before.shape[1]]), np.array(extent[:1]), np.array(extent[1:]), before
        first = np.flatnonzero(np.diff(code, prepend=-1))
        width, height = np.maximum.reduceat(width, first), np.maximum.reduceat(height, first)
        last, end = first[-1], ids.slice(len(ids) - 1, 1)
        if len(first) > 1:
            whole = ids.take(pa.array(first[1:] - 1))
            yield whole, first, width[:-1], height[:-1], cells[:, :last]
        kept = cells[:, last:]
        held = end, (width[-1], height[-1]), _as_runs(kept) if kept.shape[1] > STROKES_HELD else kept
    if held is not None:
        old, extent, before = held
        yield old, np.array([0, before.shape[1]]), np.array(extent[:1]), np.array(extent[1:]), before


def _stacks(first: np.ndarray, width: np.ndarray, height: np.ndarray, cells: np.ndarray, pages: np.ndarray):
    """Stacks of ``pages`` of at most ``GRID_CELLS`` cells: page numbers, grid shape, words."""
    rows, columns = (height / CELL).astype(int) + 1, (width / CELL).astype(int) + 1
    order = pages[np.lexsort((columns[pages], rows[pages]))]  # pages of one size go together
    while len(order):
        cost = np.maximum.accumulate(rows[order]) * np.maximum.accumulate(columns[order]) * np.arange(1, len(order) + 1)
        some, order = np.split(order, [max(1, int(np.searchsorted(cost, GRID_CELLS, "right")))])
        n = first[some + 1] - first[some]
        at = np.repeat(first[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
        shape = len(some), int(rows[some].max()), int(columns[some].max())
        yield some, shape, _words(np.repeat(np.arange(len(some)), n), cells[:, at], shape)


def _in_order(strokes: DataFrame) -> DataFrame:
    """Cells of the strokes, each page in one task and in one piece; what is shuffled is strokes, not cells."""
    return stroke_cells(strokes).repartition("page_id").sortWithinPartitions("page_id")


def occupied_rows(strokes: DataFrame) -> DataFrame:
    """``page_id, cy, cells``: how many cells of each grid row the strokes of a page touch."""
    def count(batches):
        for ids, first, width, height, cells in _by_page(batches):
            for some, _, words in _stacks(first, width, height, cells, np.arange(len(ids))):
                n = np.bitwise_count(words).sum(axis=2, dtype=np.int64)
                page, cy = np.nonzero(n)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some[page])), pa.array(cy), pa.array(n[page, cy])],
                                                 names=["page_id", "cy", "cells"])
    kind = strokes.schema["page_id"].dataType.simpleString()
    return _in_order(strokes).mapInArrow(count, f"page_id {kind}, cy long, cells long")


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index of every run of consecutive ``keys``, and the run that each key is in."""
    first = np.flatnonzero(np.diff(keys, prepend=-2) != 1)
    return first, np.cumsum(np.diff(keys, prepend=-2) != 1) - 1


def components(grids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occupied cells (flat index) of a stack of grids, and the lowest index in each one's 4-connected group.

    Lowest indices spread over whole horizontal and vertical runs in turn, for all
    grids at once, until nothing changes.
    """
    pages, height, width = grids.shape
    flat = np.flatnonzero(grids)
    label = flat.copy()
    if not len(flat):
        return flat, label
    page, y, x = np.unravel_index(flat, grids.shape)
    across, in_row = _runs((page * height + y) * (width + 1) + x)
    down = (page * width + x) * (height + 1) + y
    order = np.argsort(down)
    along, in_column = _runs(down[order])
    while True:
        spread = np.minimum.reduceat(label, across)[in_row]
        spread[order] = np.minimum.reduceat(spread[order], along)[in_column]
        if np.array_equal(spread, label):
            return flat, label
        label = spread


def _grown(grids: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Every cell and its four neighbours, on the page."""
    wide = grids.copy()
    wide[:, 1:] |= grids[:, :-1]
    wide[:, :-1] |= grids[:, 1:]
    wide[:, :, 1:] |= grids[:, :, :-1]
    wide[:, :, :-1] |= grids[:, :, 1:]
    return wide & inside


def _figure_boxes(page, x0, y0, x1, y1, width: np.ndarray, height: np.ndarray) -> pd.DataFrame:
    """Boxes on the page from first and last cells, where they are figure-sized."""
    box = pd.DataFrame({
        "page": page, "x0": np.maximum(x0 * CELL - PAD, 0.0), "y0": np.maximum(y0 * CELL - PAD, 0.0),
        "x1": np.minimum((x1 + 1) * CELL + PAD, width[page]), "y1": np.minimum((y1 + 1) * CELL + PAD, height[page])})
    box["share"] = (box.x1 - box.x0) * (box.y1 - box.y0) / (width[page] * height[page])
    return box[box.share.between(MIN_AREA, MAX_AREA) & (box.x1 - box.x0 > MIN_SIDE) & (box.y1 - box.y0 > MIN_SIDE)]


def _largest(found: list[pd.DataFrame]) -> pd.DataFrame:
    boxes = pd.concat(found) if found else pd.DataFrame(columns=["page", "x0", "y0", "x1", "y1", "share"])
    boxes = boxes.sort_values(["page", "share", "y0", "x0", "x1", "y1"], ascending=[True, False, True, True, True, True])
    boxes["figure_no"] = boxes.groupby("page").cumcount()
    return boxes[boxes.figure_no < MAX_FIGURES]


def _cluster_boxes(grids: np.ndarray, inside: np.ndarray, width: np.ndarray, height: np.ndarray) -> pd.DataFrame:
    """Figure-sized boxes of each page, at the widest dilation that gives the page any."""
    found, todo = [], np.arange(len(grids))
    for spread in range(DILATE, -1, -1):
        wide = grids[todo]
        for _ in range(spread):
            wide = _grown(wide, inside[todo])
        flat, label = components(wide)
        if not len(flat):
            break
        order = np.argsort(label, kind="stable")
        start = np.flatnonzero(np.diff(label[order], prepend=-1))
        at, y, x = (a[order] for a in np.unravel_index(flat, wide.shape))
        page = todo[at[start]]
        box = _figure_boxes(page, *(f.reduceat(c, start) for f, c in ((np.minimum, x), (np.minimum, y), (np.maximum, x), (np.maximum, y))),
                            width, height)
        found.append(box)
        todo = np.setdiff1d(todo, box.page)
    return _largest(found)


def _near(cells: np.ndarray, first: np.ndarray, pages: np.ndarray, steps: int) -> np.ndarray:
    """Lowest stroke of each stroke's group, per page of ``pages``, where grown strokes touch if they lie within
    ``steps`` cells; the pages have one number of strokes."""
    n = first[pages[0] + 1] - first[pages[0]]
    x0, x1, y0, y1 = cells[:, first[pages][:, None] + np.arange(n)]
    across = np.maximum(np.maximum(x0[:, :, None] - x1[:, None, :], x0[:, None, :] - x1[:, :, None]), 0)
    down = np.maximum(np.maximum(y0[:, :, None] - y1[:, None, :], y0[:, None, :] - y1[:, :, None]), 0)
    touch = across + down <= steps
    label = np.broadcast_to(np.arange(n), x0.shape)
    while True:
        spread = np.where(touch, label[:, None, :], n).min(axis=2)
        if np.array_equal(spread, label):
            return label
        label = spread


def _few_strokes(first: np.ndarray, width: np.ndarray, height: np.ndarray, cells: np.ndarray, pages: np.ndarray) -> pd.DataFrame:
    """``_cluster_boxes`` of pages with few strokes, from the distances between these: strokes grown by n cells
    meet where their cells lie within 2n + 1 steps, and a group's box is its strokes' box grown by n cells."""
    found, size = [], (first[1:] - first[:-1])[pages]
    for n in np.unique(size):
        todo = pages[size == n]
        for spread in range(DILATE, -1, -1):
            if not len(todo):
                break
            label = _near(cells, first, todo, 2 * spread + 1)
            at = (first[todo][:, None] + np.arange(n)).ravel()
            group = (np.arange(len(todo))[:, None] * n + label).ravel()
            order = np.argsort(group, kind="stable")
            start = np.flatnonzero(np.diff(group[order], prepend=-1))
            page = todo[group[order][start] // n]
            x0, x1, y0, y1 = (c[at][order] for c in cells)
            x0, y0 = (np.maximum(np.minimum.reduceat(c, start) - spread, 0) for c in (x0, y0))
            x1 = np.minimum(np.maximum.reduceat(x1, start) + spread, (width[page] / CELL).astype(int))
            y1 = np.minimum(np.maximum.reduceat(y1, start) + spread, (height[page] / CELL).astype(int))
            box = _figure_boxes(page, x0, y0, x1, y1, width, height)
            found.append(box)
            todo = np.setdiff1d(todo, box.page)
    return _largest(found)


def _clusters(batches):
    for ids, first, width, height, cells in _by_page(batches):
        few = np.diff(first) <= FEW_STROKES
        boxes = [_few_strokes(first, width, height, cells, np.flatnonzero(few))]
        for some, (_, high, wide), words in _stacks(first, width, height, cells, np.flatnonzero(~few)):
            rows, columns = (height[some] / CELL).astype(int) + 1, (width[some] / CELL).astype(int) + 1
            inside = (np.arange(high)[None, :, None] < rows[:, None, None]) & (np.arange(wide)[None, None, :] < columns[:, None, None])
            box = _cluster_boxes(_bits(words, wide) & inside, inside, width[some], height[some])
            boxes.append(box.assign(page=some[box.page.to_numpy(int)]))
        for box in boxes:
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(box.page.to_numpy(np.int64))), pa.array(box.figure_no.to_numpy(np.int32)),
                 *[pa.array(box[c].to_numpy(float)) for c in ("share", "x0", "y0", "x1", "y1")]],
                names=["page_id", "figure_no", "share", "x0", "y0", "x1", "y1"])


def drawing_clusters(strokes: DataFrame) -> DataFrame:
    """Figure boxes found in each page's strokes, largest first (then from the top left).

    A page with few strokes is clustered by the distances between them, others on their grids, in stacks of at
    most ``GRID_CELLS`` cells.  What is held of a page is bounded by the sheet size however many strokes it has.
    """
    kind = strokes.schema["page_id"].dataType.simpleString()
    return _in_order(strokes).mapInArrow(
        _clusters, f"page_id {kind}, figure_no int, share double, x0 double, y0 double, x1 double, y1 double")


def ordered_figure_files(figures: DataFrame) -> DataFrame:
    """File list of the figure export, in archive order."""
    return figures.select("filename").orderBy("filename")
