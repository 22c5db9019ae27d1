"""Figures, boxes, image descriptors and region vectors over whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from plansift.functions import text as T, vectors as X
from plansift.operators import descriptors, figures as G, images, rank
from plansift.operators.relational import top_per_key
from plansift.plans.registered import sqlparts as S
from plansift.plans.registered.search import _SEARCH, ranked
from plansift.sources import standin

QUERIES, ORACLE = {}, {}
TERMS = ("erth", "ontion", "the")


def registered(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return add


@registered(f"WITH {S.FIGURES} SELECT page_id, count(*) AS figure_count FROM figures_v WHERE kind = 'drawing' GROUP BY 1")
def drawing_counts(spark, sf_dir):
    return rank.drawing_counts(standin.figures(spark, sf_dir))


@registered(f"""WITH {S.FIGURES} SELECT page_id, rank, figure_id, kind, area FROM (SELECT *, row_number() OVER (PARTITION BY page_id
 ORDER BY CASE kind WHEN 'drawing' THEN 0 ELSE 1 END, area DESC, figure_id) AS rank FROM figures_v) WHERE rank <= 4""")
def figures_per_page(spark, sf_dir):
    drawing_first = F.when(F.col("kind") == "drawing", 0).otherwise(1)
    top = top_per_key(standin.figures(spark, sf_dir), ["page_id"],
                      [drawing_first, F.desc("area"), F.asc("figure_id")], G.FIGURES_PER_PAGE)
    return top.select("page_id", "rank", "figure_id", "kind", "area")


@registered(f"""{_SEARCH}, on_page AS (SELECT * FROM (SELECT r.qid, r.rank AS page_rank, f.*, row_number() OVER (PARTITION BY r.qid, f.page_id
 ORDER BY CASE f.kind WHEN 'drawing' THEN 0 ELSE 1 END, f.area DESC, f.figure_id) AS slot FROM ranked r JOIN figures_v f ON f.page_id = r.page_id) WHERE slot <= 4)
SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY page_rank, slot) AS rank, page_id, '/media/' || filename AS url, '/media/' || thumb AS thumb_url, kind FROM on_page) WHERE rank <= 12""")
def figures_for_answer(spark, sf_dir):
    found = G.figures_for_pages(ranked(spark, sf_dir).select("qid", "page_id", "rank"), standin.figures(spark, sf_dir))
    return found.select("qid", "rank", "page_id", "url", "thumb_url", "kind")


_CROP = """placed AS (SELECT *, greatest(mx, x0) AS ix0, greatest(my, y0) AS iy0, least(mx + mw, x1) AS ix1, least(my + mh, y1) AS iy1 FROM pairs),
inside AS (SELECT * FROM placed WHERE x1 > x0 AND y1 > y0 AND ix1 > ix0 AND iy1 > iy0
 AND (ix1 - ix0) * (iy1 - iy0) / (CASE WHEN (mx + mw - mx) * (my + mh - my) = 0 THEN 1e-9 ELSE (mx + mw - mx) * (my + mh - my) END) >= 0.5e0)"""


@registered(f"""WITH {S.FIGURES}, {S.BOXES}, marks AS (SELECT * FROM (SELECT page_id, box_id, x, y, w, h, row_number() OVER (PARTITION BY page_id ORDER BY box_id) AS mark FROM boxes_v
 WHERE contains(lower(text), 'erth') OR contains(lower(text), 'ontion') OR contains(lower(text), 'the')) WHERE mark <= 60),
pairs AS (SELECT page_id, figure_id, box_id, x AS mx, y AS my, w AS mw, h AS mh, x0, y0, x1, y1 FROM marks JOIN figures_v USING (page_id)), {_CROP}
SELECT figure_id, box_id, round(((ix0 - x0) / (x1 - x0))::VARCHAR::DECIMAL(38,20), 5)::DOUBLE AS x, round(((iy0 - y0) / (y1 - y0))::VARCHAR::DECIMAL(38,20), 5)::DOUBLE AS y, round(((ix1 - ix0) / (x1 - x0))::VARCHAR::DECIMAL(38,20), 5)::DOUBLE AS w, round(((iy1 - iy0) / (y1 - y0))::VARCHAR::DECIMAL(38,20), 5)::DOUBLE AS h FROM inside""")
def marks_in_figures(spark, sf_dir):
    boxes = standin.ocr_boxes(spark, sf_dir)
    terms = F.array(*[F.lit(t) for t in TERMS])
    hits = top_per_key(boxes.filter(F.exists(terms, lambda t: F.contains(F.lower("text"), t))), ["page_id"],
                       [F.asc("box_id")], G.MARK_LIMIT, rank="mark_no")
    marks = hits.select("page_id", "box_id", F.col("box").alias("mark"))
    placed = G.marks_in_figures(marks, standin.figures(spark, sf_dir).select("page_id", "figure_id", "box"))
    return placed.select("figure_id", "box_id", "placed.*")


@registered(f"""{_SEARCH}, {S.BOXES}, terms_v AS (SELECT qid, page_id, list_filter(expanded, lambda t: length(t) > 2) AS terms FROM ranked),
hits AS (SELECT qid, page_id, box_id, x, y, w, h, row_number() OVER (PARTITION BY qid, page_id ORDER BY box_id) AS mark FROM boxes_v JOIN terms_v USING (page_id)
 WHERE len(list_filter(terms, lambda t: contains(lower(text), t))) > 0) SELECT qid, page_id, mark, box_id, x, y, w, h FROM hits WHERE mark <= 60""")
def ocr_highlights(spark, sf_dir):
    from plansift.plans.registered.inputs import QUESTIONS, question_table
    asked = rank.understand(question_table(spark, QUESTIONS), standin.VOCABULARY).select("qid", F.col("expanded").alias("terms"))
    pages = ranked(spark, sf_dir).select("qid", "page_id").join(asked, "qid")
    hits = G.ocr_highlights(standin.ocr_boxes(spark, sf_dir), pages)
    return hits.select("qid", "page_id", "mark", "box_id", "box.*")


@registered(f"""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN x1 > x0 AND y1 > y0 THEN round(x0 / 600, 5) END AS x, CASE WHEN x1 > x0 AND y1 > y0 THEN round(y0 / 800, 5) END AS y,
 CASE WHEN x1 > x0 AND y1 > y0 THEN round((x1 - x0) / 600, 5) END AS w, CASE WHEN x1 > x0 AND y1 > y0 THEN round((y1 - y0) / 800, 5) END AS h FROM (SELECT l_orderkey, l_linenumber,
 greatest(least(l_quantity * 20 - 100, l_suppkey * 5.0e0), 0.0e0) AS x0, least(greatest(l_quantity * 20 - 100, l_suppkey * 5.0e0), 600.0e0) AS x1,
 greatest(least(l_discount * 4000, l_tax * 9000), 0.0e0) AS y0, least(greatest(l_discount * 4000, l_tax * 9000), 800.0e0) AS y1 FROM lineitem)""")
def quad_boxes(spark, sf_dir):
    li = standin.table(spark, sf_dir, "lineitem")
    xs = F.array(F.col("l_quantity") * 20 - 100, F.col("l_suppkey") * F.lit(5.0))
    ys = F.array(F.col("l_discount") * 4000, F.col("l_tax") * 9000)
    box = li.select("l_orderkey", "l_linenumber", X.quad_to_box(xs, ys, F.lit(600.0), F.lit(800.0)).alias("box"))
    return box.select("l_orderkey", "l_linenumber", "box.x", "box.y", "box.w", "box.h")


@registered(f"""SELECT doc_id, {S.page_image("source || '/' || lang || ' v1.2 notes.pdf'", 'doc_id::INT')} AS page_image,
 {S.page_image("source || '/' || lang || ' v1.2 notes.pdf'", 'doc_id::INT', '_thumb')} AS thumb, round(n_chars / 612.0e0, 5) AS fraction FROM documents""")
def page_paths(spark, sf_dir):
    docs = standin.table(spark, sf_dir, "documents")
    name = F.concat("source", F.lit("/"), "lang", F.lit(" v1.2 notes.pdf"))
    page = F.col("doc_id").cast("int")
    return docs.select("doc_id", T.page_image(name, page).alias("page_image"),
                       T.page_image(name, page, "_thumb").alias("thumb"),
                       X.page_fraction(F.col("n_chars"), F.lit(0.0), F.lit(612.0)).alias("fraction"))


@registered(f"WITH {S.FIGURES} SELECT filename FROM figures_v")
def figure_export_list(spark, sf_dir):
    return G.ordered_figure_files(standin.figures(spark, sf_dir))


# ---------------------------------------------------------------- image similarity
def _descriptors(spark, sf_dir):
    """Bit hashes of each vector: above its median, and above its left neighbour."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = standin.table(spark, sf_dir, "embeddings").select("vec_id", "label", e.alias("v"))
    n = F.size("v")
    median = T.let(F.array_sort("v"), lambda s: (F.element_at(s, (n / 2).cast("int")) + F.element_at(s, (n / 2).cast("int") + 1)) / 2)
    rows = rows.withColumn("median", median)
    pbits = T.let(F.col("median"), lambda m: F.transform("v", lambda x: x > m))
    dbits = F.transform(F.sequence(F.lit(2), n), lambda i: F.element_at("v", i) > F.element_at("v", i - 1))
    return rows.select(F.col("vec_id").alias("image_key"), "label", X.bits_to_long(pbits).alias("phash"),
                       F.array(X.bits_to_long(dbits)).alias("dhash"), F.col("v").alias("edge"))


_HASHES = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
h AS (SELECT vec_id AS image_key, label, v AS edge, list_transform(v, lambda x: x > list_median(v)) AS p, list_transform(range(2, len(v) + 1), lambda i: v[i] > v[i - 1]) AS d FROM v),
query AS (SELECT * FROM h WHERE image_key = 7),
dist AS (SELECT h.image_key, h.label, len(list_filter(list_zip(h.p, query.p), lambda z: z[1] <> z[2])) AS phash_distance,
 len(list_filter(list_zip(h.d, query.d), lambda z: z[1] <> z[2])) AS dhash_distance, list_dot_product(h.edge, query.edge) AS edge_dot FROM h, query),
sim AS (SELECT *, 0.2e0 * (1.0e0 - phash_distance / 64.0e0) + 0.25e0 * (1.0e0 - dhash_distance / 64.0e0) + 0.55e0 * greatest(least(edge_dot, 1.0e0), 0.0e0) AS similarity FROM dist)"""
_HASHES = _HASHES.replace("list_median(v)", "list_aggregate(v, 'median')")


def _example(spark, sf_dir):
    return _descriptors(spark, sf_dir).filter(F.col("image_key") == 7)


@registered(f"WITH {_HASHES} SELECT image_key, phash_distance::BIGINT AS phash_distance, dhash_distance::BIGINT AS dhash_distance, round(similarity, 6) AS similarity FROM sim")
def hash_similarity(spark, sf_dir):
    rows = images.descriptor_similarity(_descriptors(spark, sf_dir), _example(spark, sf_dir), dhash_bits=64)
    return rows.select("image_key", "phash_distance", "dhash_distance", F.round("similarity", 6).alias("similarity"))


@registered(f"""WITH {_HASHES}, a AS (SELECT 'catalogue' AS kind, image_key, similarity FROM sim WHERE label < 5 ORDER BY similarity DESC, image_key LIMIT 32),
b AS (SELECT 'part' AS kind, image_key, similarity FROM sim WHERE label >= 5 ORDER BY similarity DESC, image_key LIMIT 32)
SELECT kind, image_key, round(similarity, 6) AS similarity, CAST(round_even(100.0e0 * greatest(least(similarity, 1.0e0), 0.0e0), 0) AS BIGINT) AS percent, similarity >= 0.85e0 AS match
 FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY similarity DESC, kind, image_key LIMIT 8""")
def find_by_image(spark, sf_dir):
    library = _descriptors(spark, sf_dir)
    top = images.find_by_hash(library.filter("label < 5"), library.filter("label >= 5"), _example(spark, sf_dir), dhash_bits=64)
    return top.select("kind", "image_key", F.round("similarity", 6).alias("similarity"), "percent", "match")


def _figure_library(spark, sf_dir):
    """Every figure (repeated numbers once) with the descriptors of the vector its number falls on."""
    n = standin.table(spark, sf_dir, "embeddings").count()
    figures = standin.figures(spark, sf_dir).groupBy("figure_id", "page_id", "filename").agg(F.min("kind").alias("kind")).withColumn("vec", F.pmod("figure_id", F.lit(n)))
    return figures.join(_descriptors(spark, sf_dir).withColumnRenamed("image_key", "vec"), "vec").withColumn("image_key", F.col("figure_id"))


@registered(f"""WITH {S.PAGES}, {S.FIGURES}, {_HASHES}, once AS (SELECT figure_id, page_id, filename, min(kind) AS kind FROM figures_v GROUP BY 1, 2, 3),
lib AS (SELECT figure_id, f.page_id, f.filename, kind, similarity FROM once f JOIN sim ON f.figure_id % (SELECT count(*) FROM embeddings) = sim.image_key),
top AS (SELECT * FROM lib ORDER BY similarity DESC, figure_id LIMIT 8)
SELECT figure_id AS image_key, round(similarity, 6) AS similarity, kind, '/media/' || top.filename AS url, page_id, doc_id, p.filename, p.title, system, page_num FROM top LEFT JOIN pages_v p USING (page_id)""")
def image_hits_on_pages(spark, sf_dir):
    library = _figure_library(spark, sf_dir)
    top = images.find_by_hash(library, library.limit(0), _example(spark, sf_dir), dhash_bits=64).select("image_key", "similarity")
    placed = images.with_pages(top, library.drop("label"), standin.pages(spark, sf_dir))
    return placed.select("image_key", F.round("similarity", 6).alias("similarity"), "kind", "url", "page_id", "doc_id", "filename",
                         "title", "system", F.col("page_num").cast("bigint").alias("page_num"))


def _regions(spark, sf_dir):
    e = standin.table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("image_key"), F.col("vec_id").alias("region_no"), F.col("embedding").alias("vec"))


def _windows(spark, sf_dir):
    e = standin.table(spark, sf_dir, "embeddings").filter(F.col("vec_id").isin(3, 11, 29))
    return e.select(F.col("vec_id").alias("window_no"), F.col("embedding").alias("vec"))


_REGION = """sims AS (SELECT w.vec_id AS window_no, e.label::BIGINT AS image_key, e.vec_id AS region_no, list_dot_product(e.embedding::DOUBLE[], w.embedding::DOUBLE[]) AS score
 FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id IN (3, 11, 29)) w),
best AS (SELECT image_key, arg_min(region_no, (-score, region_no)) AS region_no, max(score) AS score FROM sims GROUP BY 1)"""


@registered(f"WITH {_REGION} SELECT image_key, region_no, round(score, 6) AS score FROM best")
def best_region_per_image(spark, sf_dir):
    best = images.best_regions(_regions(spark, sf_dir), _windows(spark, sf_dir))
    return best.select("image_key", "region_no", F.round("score", 6).alias("score"))


@registered(f"""WITH {_REGION}, inl AS (SELECT label::BIGINT AS image_key, count(*) AS inliers FROM embeddings WHERE embedding[1] > 0.15 GROUP BY 1),
short AS (SELECT * FROM best ORDER BY score DESC, image_key LIMIT 32)
SELECT image_key, round(score, 6) AS score, coalesce(inliers, -1) AS inliers, coalesce(inliers, -1) >= 15 AS match FROM short LEFT JOIN inl USING (image_key)
 ORDER BY greatest(coalesce(inliers, -1), 0) DESC, score DESC, image_key LIMIT 8""")
def rerank_shortlist(spark, sf_dir):
    best = images.best_regions(_regions(spark, sf_dir), _windows(spark, sf_dir))
    # stand-in for the geometric check: a count per image
    inliers = standin.table(spark, sf_dir, "embeddings").filter(F.col("embedding")[0] > 0.15).groupBy(
        F.col("label").alias("image_key")).agg(F.count(F.lit(1)).alias("inliers"))
    top = images.rerank(best, inliers)
    return top.select("image_key", F.round("score", 6).alias("score"), "inliers", "match")


# ------------------------------------------------------- pixel descriptors, clusters
@registered()
def image_descriptors(spark, sf_dir):
    """Descriptors of every vector drawn as an 8x8 grey image."""
    rows = standin.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_key"), F.lit(8).alias("width"), F.lit(8).alias("height"),
        F.transform("embedding", lambda x: F.least(F.greatest((x + 0.5) * 255, F.lit(0.0)), F.lit(255.0)).cast("int"))
        .alias("pixels"))
    found = descriptors.describe(rows)
    return found.select("image_key", "phash", F.array_join(F.transform("dhash", lambda d: d.cast("string")), ",").alias("dhash"),
                        F.round(F.aggregate("edge", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("edge_norm"))


@registered("""WITH spots AS (SELECT 0 AS window_no, 0 AS r0, 0 AS c0, 4 AS side UNION ALL SELECT 1 + 3 * r + c, r, c, 2 FROM range(3) a(r), range(3) b(c)),
cells AS (SELECT vec_id AS image_key, r, c, k, embedding[16 * r + 4 * c + k + 1]::DOUBLE AS x, embedding[16 * r + 4 * c + 1]::DOUBLE AS grey FROM embeddings, range(4) a(r), range(4) b(c), range(4) d(k)),
pooled AS (SELECT image_key, window_no, k, avg(x) AS mean, stddev_pop(grey) AS spread FROM cells JOIN spots ON r >= r0 AND r < r0 + side AND c >= c0 AND c < c0 + side GROUP BY 1, 2, 3),
normed AS (SELECT *, sqrt(sum(mean * mean) OVER (PARTITION BY image_key, window_no)) AS norm FROM pooled WHERE window_no = 0 OR spread >= 0.05e0)
SELECT image_key, window_no::BIGINT AS window_no, k::BIGINT AS dimension, round((CASE WHEN norm > 0 THEN mean / norm ELSE mean END)::FLOAT::DOUBLE, 4) + 0.0e0 AS value FROM normed""")
def window_vectors(spark, sf_dir):
    """Pooled window vectors of every vector read as a 4x4 grid of 4-dimensional patches, the first value as brightness."""
    grids = standin.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_key"), F.col("embedding").alias("patches"),
        F.transform(F.sequence(F.lit(1), F.lit(61), F.lit(4)), lambda i: F.element_at("embedding", i)).alias("grey"))
    found = descriptors.window_vectors(grids, grid=4, scales=((2, 1),))
    rows = found.select("image_key", "window_no", F.posexplode("vec").alias("dimension", "x"))
    return rows.select("image_key", "window_no", "dimension", (F.round(F.col("x").cast("double"), 4) + F.lit(0.0)).alias("value"))


def _strokes(spark, sf_dir):
    li = standin.table(spark, sf_dir, "lineitem")
    x, y = F.col("l_suppkey") % 50 * F.lit(10.0), F.col("l_partkey") % 70 * F.lit(10.0)
    return li.select(F.col("l_orderkey").alias("page_id"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"),
                     x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity") * 4).alias("x1"), (y + F.col("l_discount") * 2000 + 5).alias("y1"))


@registered("""WITH s AS (SELECT l_orderkey AS page_id, l_suppkey % 50 * 10.0e0 AS x0, l_partkey % 70 * 10.0e0 AS y0, least(l_suppkey % 50 * 10.0e0 + l_quantity * 4, 595.0e0) AS x1,
 least(l_partkey % 70 * 10.0e0 + (l_discount * 2000 + 5), 842.0e0) AS y1 FROM lineitem),
b AS (SELECT page_id, floor(x0 / 6)::INT AS c0, least(floor(x1 / 6)::INT, 99) AS c1, floor(y0 / 6)::INT AS r0, least(floor(y1 / 6)::INT, 140) AS r1 FROM s
 WHERE x1 > x0 AND y1 > y0 AND (x1 - x0) * (y1 - y0) <= 0.5e0 * 595 * 842),
c AS (SELECT page_id, unnest(range(c0, c1 + 1)) AS cx, r0, r1 FROM b), g AS (SELECT DISTINCT page_id, cx, unnest(range(r0, r1 + 1)) AS cy FROM c)
SELECT page_id, cy, count(*) AS cells FROM g GROUP BY 1, 2""")
def occupancy_grid(spark, sf_dir):
    return G.occupied_rows(_strokes(spark, sf_dir))


# strokes grown by n cells belong together where their cells lie within 2n + 1 steps of each other
_CLUSTERS = """WITH RECURSIVE s AS (SELECT l_orderkey AS page_id, l_suppkey % 50 * 10.0e0 AS x0, l_partkey % 70 * 10.0e0 AS y0, least(l_suppkey % 50 * 10.0e0 + l_quantity * 4, 595.0e0) AS x1,
 least(l_partkey % 70 * 10.0e0 + (l_discount * 2000 + 5), 842.0e0) AS y1 FROM lineitem),
b AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY x0, y0, x1, y1) AS i, floor(x0 / 6)::INT AS c0, least(floor(x1 / 6)::INT, 99) AS c1,
 floor(y0 / 6)::INT AS r0, least(floor(y1 / 6)::INT, 140) AS r1 FROM s WHERE x1 > x0 AND y1 > y0 AND (x1 - x0) * (y1 - y0) <= 0.5e0 * 595 * 842),
edges AS (SELECT a.page_id, n, a.i, b.i AS j FROM b a JOIN b ON a.page_id = b.page_id CROSS JOIN (VALUES (0), (1), (2)) t(n)
 WHERE greatest(a.c0 - b.c1, b.c0 - a.c1, 0) + greatest(a.r0 - b.r1, b.r0 - a.r1, 0) <= 2 * n + 1),
reach AS (SELECT page_id, n, i, j FROM edges UNION SELECT r.page_id, r.n, r.i, e.j FROM reach r JOIN edges e ON e.page_id = r.page_id AND e.n = r.n AND e.i = r.j),
groups AS (SELECT page_id, n, i, min(j) AS g FROM reach GROUP BY 1, 2, 3),
boxes AS (SELECT page_id, n, greatest(greatest(min(c0) - n, 0) * 6.0e0 - 7, 0) AS x0, greatest(greatest(min(r0) - n, 0) * 6.0e0 - 7, 0) AS y0,
 least((least(max(c1) + n, 99) + 1) * 6.0e0 + 7, 595) AS x1, least((least(max(r1) + n, 140) + 1) * 6.0e0 + 7, 842) AS y1 FROM groups JOIN b USING (page_id, i) GROUP BY page_id, n, g),
sized AS (SELECT *, (x1 - x0) * (y1 - y0) / (595.0e0 * 842.0e0) AS share FROM boxes),
figure AS (SELECT *, max(n) OVER (PARTITION BY page_id) AS widest FROM sized WHERE share BETWEEN 0.010e0 AND 0.88e0 AND x1 - x0 > 24 AND y1 - y0 > 24)
SELECT page_id, figure_no, round(share, 6) AS share, x0, y0, x1, y1 FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY share DESC, y0, x0, x1, y1) - 1 AS figure_no
 FROM figure WHERE n = widest) WHERE figure_no < 8"""


@registered(_CLUSTERS)
def drawing_clusters(spark, sf_dir):
    return G.drawing_clusters(_strokes(spark, sf_dir)).select(
        "page_id", "figure_no", F.round("share", 6).alias("share"), "x0", "y0", "x1", "y1")
