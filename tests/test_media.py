from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from plansift.functions import vectors as X
from plansift.operators import descriptors as D, figures as G, images, relational as Rel


def test_marks_are_clipped_and_rescaled(table):
    marks = table("page_id long, x double, y double, w double, h double", [
        (1, .5, .5, .1, .1), (1, 0, 0, .05, .05), (1, .36, .4, .1, .1), (1, .34, .4, .1, .1), (1, .39, .4, .1, .1), (2, .5, .5, .1, .1)])
    marks = marks.select("page_id", F.struct("x", "y", "w", "h").alias("mark"))
    crop = table("page_id long, x0 double, y0 double, x1 double, y1 double", [(1, .4, .4, .8, .8), (3, 0, 0, 1, 1)])
    crop = crop.select("page_id", F.struct("x0", "y0", "x1", "y1").alias("box"))
    got = sorted(tuple(r.placed) for r in G.marks_in_figures(marks, crop).collect())
    assert got == [(0.0, 0.0, 0.15, 0.25), (0.0, 0.0, 0.225, 0.25), (0.25, 0.25, 0.25, 0.25)]


def test_figures_prefer_drawings_then_size(table):
    figures = table("figure_id long, page_id long, kind string, area double, filename string, thumb string", [
        (1, 1, "raster", 9.0, "a", ""), (2, 1, "drawing", 1.0, "b", "bt"), (3, 1, "drawing", 5.0, "c", None),
        (4, 2, "raster", 1.0, "d", ""), (5, 9, "drawing", 1.0, "e", "")])
    ranked = table("qid int, page_id long, rank int", [(1, 2, 1), (1, 1, 2)])
    rows = sorted(G.figures_for_pages(ranked, figures, 3, 2).collect(), key=lambda r: r["rank"])
    assert [(r.figure_id, r.thumb_url) for r in rows] == [(4, "/media/d"), (3, "/media/c"), (2, "/media/bt")]


def bfs_boxes(cells, width, height):
    """Cell-by-cell search, the plain statement of connected groups."""
    seen, boxes = set(), []
    for start in sorted(cells, key=lambda c: (c[1], c[0])):
        if start in seen:
            continue
        queue, group = deque([start]), [start]
        seen.add(start)
        while queue:
            x, y = queue.popleft()
            for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if n in cells and n not in seen:
                    seen.add(n)
                    group.append(n)
                    queue.append(n)
        xs, ys = [c[0] for c in group], [c[1] for c in group]
        x0, y0 = max(min(xs) * 6.0 - 7, 0), max(min(ys) * 6.0 - 7, 0)
        x1, y1 = min((max(xs) + 1) * 6.0 + 7, width), min((max(ys) + 1) * 6.0 + 7, height)
        share = (x1 - x0) * (y1 - y0) / (width * height)
        if 0.01 <= share <= 0.88 and x1 - x0 > 24 and y1 - y0 > 24:
            boxes.append((share, x0, y0, x1, y1))
    return boxes


def brute_clusters(strokes, width, height):
    nx, ny = int(width / 6) + 1, int(height / 6) + 1
    cells = set()
    for x0, y0, x1, y1 in strokes:
        x0, y0, x1, y1 = max(x0, 0), max(y0, 0), min(x1, width), min(y1, height)
        if x1 <= x0 or y1 <= y0 or (x1 - x0) * (y1 - y0) > width * height / 2:
            continue
        cells |= {(x, y) for x in range(int(x0 / 6), min(int(x1 / 6), nx - 1) + 1)
                  for y in range(int(y0 / 6), min(int(y1 / 6), ny - 1) + 1)}
    for spread in (2, 1, 0):
        wide = set(cells)
        for _ in range(spread):
            wide |= {(x + dx, y + dy) for x, y in wide for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))
                     if 0 <= x + dx < nx and 0 <= y + dy < ny}
        boxes = bfs_boxes(wide, width, height)
        if boxes:
            return sorted(boxes, key=lambda b: -b[0])[:8]
    return []


def test_drawing_clusters_equal_cell_search(table):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for page in range(12):
        width, height = [(595.0, 842.0), (700.0, 300.0), (120.0, 90.0)][page % 3]
        strokes = [(x, y, x + w, y + h) for x, y, w, h in zip(
            rng.uniform(-20, width, 2 + page * 3), rng.uniform(-20, height, 2 + page * 3),
            rng.uniform(1, 90, 2 + page * 3), rng.uniform(1, 60, 2 + page * 3))]
        strokes.append((0, 0, width, height * 0.9))  # a border counts for nothing
        rows += [(page, width, height, *map(float, s)) for s in strokes]
        want[page] = brute_clusters(strokes, width, height)
    df = table("page_id long, width double, height double, x0 double, y0 double, x1 double, y1 double", rows)
    got = {page: [] for page in want}
    for r in sorted(G.drawing_clusters(df).collect(), key=lambda r: (r.page_id, r.figure_no)):
        got[r.page_id].append((r.share, r.x0, r.y0, r.x1, r.y1))
    assert any(want.values())
    for page in want:
        assert np.allclose(sorted(got[page]), sorted(want[page])) and len(got[page]) == len(want[page]), page


def test_strokes_are_shuffled_once_and_not_as_cells(spark, tmp_path):
    """One row a stroke leaves the scan, whatever the number of cells it covers."""
    strokes = spark.range(2000).selectExpr("id % 500 page_id", "595D width", "842D height", "50D x0", "50D y0", "500D x1", "500D y1")
    for made in (G.occupied_rows(strokes), G.drawing_clusters(strokes)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Aggregate" not in plan and plan.count("Repartition") == 1


@pytest.mark.parametrize("few, held", [(24, 10_000), (0, 10_000), (10_000, 10_000), (24, 20)])
def test_pages_across_batches_and_both_ways_of_grouping(spark, table, monkeypatch, few, held):
    monkeypatch.setattr(G, "FEW_STROKES", few)
    monkeypatch.setattr(G, "STROKES_HELD", held)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    rng, rows, want, cells = np.random.default_rng(3), [], {}, {}
    for page in (None, *range(12)):
        width, height = (595.0, 842.0) if page is None or page % 2 else (300.0, 200.0)
        n = 100 if page == 5 else int(rng.integers(1, 40))
        strokes = [(x, y, x + w, y + h) for x, y, w, h in zip(rng.uniform(0, width, n), rng.uniform(0, height, n), rng.uniform(1, 50, n), rng.uniform(1, 50, n))]
        rows += [(page, width, height, *s) for s in strokes]
        want[page] = brute_clusters(strokes, width, height)
        grid = {(int(min(y, height) // 6), int(min(x, width) // 6)) for a, b, c, d in strokes for y in np.arange(b // 6, min(d, height) // 6 + 1) * 6
                for x in np.arange(a // 6, min(c, width) // 6 + 1) * 6}
        for y, _ in grid:
            cells[page, y] = cells.get((page, y), 0) + 1
    df = table("page_id long, width double, height double, x0 double, y0 double, x1 double, y1 double", rows)
    try:
        spark.conf.set(batch, "7")
        found = {}
        for r in sorted(G.drawing_clusters(df).collect(), key=lambda r: (r.page_id or -1, r.figure_no)):
            found.setdefault(r.page_id, []).append((r.x0, r.y0, r.x1, r.y1))
        assert {p: sorted(b) for p, b in found.items()} == {
            p: sorted(tuple(float(v) for v in box[-4:]) for box in b) for p, b in want.items() if b}
        assert {(r.page_id, r.cy): r.cells for r in G.occupied_rows(df).collect()} == cells
    finally:
        spark.conf.set(batch, before)


def test_components_of_winding_shapes():
    """Spirals, combs and random cells of several pages at once, against a slow fill."""
    rng = np.random.default_rng(8)
    spiral = np.zeros((21, 21), bool)
    y, x, dy, dx = 0, 0, 0, 1
    for _ in range(400):
        spiral[y, x] = True
        ahead = (y + 2 * dy, x + 2 * dx)
        if not (0 <= y + dy < 21 and 0 <= x + dx < 21) or (0 <= ahead[0] < 21 and 0 <= ahead[1] < 21 and spiral[ahead]):
            dy, dx = dx, -dy
        if not (0 <= y + dy < 21 and 0 <= x + dx < 21) or spiral[y + dy, x + dx]:
            break
        y, x = y + dy, x + dx
    comb = np.ones((21, 21), bool)
    comb[1:, 1::2] = False
    grids = np.stack([spiral, comb, np.zeros((21, 21), bool), *[rng.random((21, 21)) < p for p in (0.3, 0.5, 0.6, 0.9)]])
    flat, label = G.components(grids)
    want = {}
    for page, grid in enumerate(grids):
        seen = np.zeros_like(grid)
        for start in zip(*np.nonzero(grid)):
            if seen[start]:
                continue
            seen[start], stack, group = True, [start], []
            while stack:
                cy, cx = stack.pop()
                group.append((page * 21 + cy) * 21 + cx)
                for ny, nx in ((cy + 1, cx), (cy - 1, cx), (cy, cx + 1), (cy, cx - 1)):
                    if 0 <= ny < 21 and 0 <= nx < 21 and grid[ny, nx] and not seen[ny, nx]:
                        seen[ny, nx] = True
                        stack.append((ny, nx))
            want |= {cell: min(group) for cell in group}
    assert dict(zip(flat.tolist(), label.tolist())) == want


def test_missing_hashes_count_as_full_distance(table):
    rows = table("image_key long, phash long, dhash string", [(1, 5, "a"), (2, None, "a"), (3, 4, None)])
    lib = rows.select("image_key", "phash", F.when(F.col("dhash").isNotNull(), F.array(F.lit(3).cast("long"))).alias("dhash"),
                      F.array(F.lit(1.0), F.lit(0.0)).alias("edge"))
    query = lib.filter("image_key = 1")
    got = {r.image_key: (r.phash_distance, r.dhash_distance, round(r.similarity, 6))
           for r in images.descriptor_similarity(lib, query, 64).collect()}
    assert got == {1: (0, 0, 1.0), 2: (999, 0, 0.8), 3: (1, 999, round(0.2 * (1 - 1 / 64) + 0.55, 6))}


def test_window_grid():
    windows = D.window_grid()
    assert len(windows) == 59 and windows[0] == (0, 0, 32, 32)
    assert sum(w[2] - w[0] == 16 for w in windows) == 9 and sum(w[2] - w[0] == 8 for w in windows) == 49


def test_window_vectors_are_unit_means(table):
    patches = np.arange(64, dtype=float).reshape(4, 4, 4)
    df = table("image_key long, patches doubles, grey doubles", [(1, list(patches.ravel()), [0.5] * 8 + [0.0, 1.0] * 4)])
    got = {r.window_no: np.array(r.vec) for r in D.window_vectors(df, 4, ((2, 1),)).collect()}
    assert 0 in got and 1 not in got  # a blank window goes, the whole image stays
    for no, (r0, c0, r1, c1) in enumerate(D.window_grid(4, ((2, 1),))):
        if no in got:
            mean = patches[r0:r1, c0:c1].mean(axis=(0, 1))
            assert got[no] == pytest.approx(mean / np.linalg.norm(mean), abs=1e-6)


def test_descriptors_recognise_the_same_picture(spark):
    rng = np.random.default_rng(1)
    base = np.kron(rng.integers(0, 255, (8, 8)), np.ones((8, 8))).astype(int)
    framed = np.full((96, 80), 255)
    framed[16:80, 8:72] = base  # white margins are cut away
    other = np.kron(rng.integers(0, 255, (8, 8)), np.ones((8, 8))).astype(int)
    rows = [(1, base), (2, framed), (3, other)]
    df = spark.createDataFrame([(k, a.shape[1], a.shape[0], a.ravel().tolist()) for k, a in rows] + [(4, 3, 3, [1])],
                               "image_key long, width int, height int, pixels array<int>")
    lib = D.describe(df)
    got = {r.image_key: r for r in lib.collect()}
    assert got[4].phash is None and len(got[1].dhash) == 4 and len(got[1].edge) == 512
    assert np.linalg.norm(got[1].edge) == pytest.approx(1.0, abs=1e-4)
    sims = {r.image_key: r.similarity for r in images.descriptor_similarity(lib, lib.filter("image_key = 1")).collect()}
    assert sims[1] == pytest.approx(1.0, abs=1e-5) and sims[2] > 0.85 > sims[3]


def test_geometry_decides_the_final_order(table):
    best = table("image_key long, score double", [(1, .9), (2, .6), (3, .5), (4, .4)])
    assert [(r.image_key, r.match) for r in images.rerank(best).collect()] == [(1, True), (2, True), (3, False), (4, False)]
    inliers = table("image_key long, inliers int", [(2, 40), (3, 15), (4, 3)])
    got = [(r.image_key, r.inliers, r.match) for r in images.rerank(best, inliers).collect()]
    assert got == [(2, 40, True), (3, 15, True), (4, 3, False), (1, -1, False)]


def test_percentages_round_half_to_even(table):
    df = table("x double", [(0.725,), (0.735,), (1.5,), (-1.0,)])
    assert [r[0] for r in df.select(X.percent(F.col("x"))).collect()] == [72, 74, 100, 0]


# ------------------------------------------------------------------ keyed rewrites
def test_update_touches_listed_rows_only(table):
    rows = table("k long, a string, b string", [(1, "x", "p"), (2, "y", "q"), (3, None, "r")])
    changes = table("k long, a string", [(2, "new"), (3, "z"), (9, "w"), (1, None)])
    got = sorted(tuple(r) for r in Rel.update_column(rows, "k", "a", changes).collect())
    assert got == [(1, None, "p"), (2, "new", "q"), (3, "z", "r")]


def test_replaced_groups_lose_every_old_row(table):
    old = table("k long, v string", [(1, "a"), (1, "b"), (2, "c")])
    fresh = table("k long, v string", [(1, "n"), (3, "m")])
    assert sorted(map(tuple, Rel.replace_groups(old, ["k"], fresh).collect())) == [(1, "n"), (2, "c"), (3, "m")]


def test_eviction_keeps_first_insertion_order(table):
    events = table("key string, at long", [("a", 1), ("b", 2), ("c", 3), ("a", 9)])
    assert [r.key for r in Rel.first_inserted(events, "key", "at", 2).collect()] == ["c", "b"]


def test_history_and_favourites(table):
    events = table("u long, i string, at long", [(1, "a", 1), (1, "b", 2), (1, "a", 3), (2, "c", 1)])
    recent = sorted((r.u, r["rank"], r.i) for r in Rel.recent_unique(events, "u", "i", "at", 1).collect())
    assert recent == [(1, 1, "a"), (2, 1, "c")]
    assert sorted((r.u, r.i) for r in Rel.toggled_on(events, "u", "i", "at", 20).collect()) == [(1, "b"), (2, "c")]


def test_every_image_keeps_its_best_region(spark):
    """Many close regions of one image take no place from another image."""
    from plansift.operators import images
    regions = spark.createDataFrame([(1, i, [1.0, i / 1e4]) for i in range(600)] + [(2, 0, [0.2, 1.0]), (3, 0, None)],
                                    "image_key int, region_no int, vec array<double>")
    windows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1])], "window_no int, vec array<double>")
    got = {r.image_key: (r.region_no, round(r.score, 6)) for r in images.best_regions(regions, windows).collect()}
    assert got == {1: (0, 1.0), 2: (0, 0.28)}
