import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from plansift import plugins
from plansift.operators import cache, rank
from plansift.plans.build import build, open_catalogue
from plansift.sources import encodings
from plansift.vocab import Vocabulary


def test_catalogue_from_sources(spark, table, tmp_path):
    long_text = "sliding rail drainage 10x2-t " + "solid words of text " * 30
    pages = table("path string, sha1 string, meta_title string, page_num int, text string", [
        ("file:/in/alpha/d9100.pdf", "s1", "", 1, long_text), ("file:/in/alpha/d9100.pdf", "s1", "", 2, "thin"),
        ("file:/in/b.pdf", "s2", "Brochure", 1, long_text)])
    cells = table("sheet string, row_no long, cells strings", [
        ("PROFILES", 1, ["Ref", "Description"]), ("PROFILES", 2, ["10x2-T", "RAIL"]), ("PROFILES", 3, ["77", "SEAL"])])
    photos = table("path string", [("x/77.jpg",), ("x/88.png",)])
    vocabulary = Vocabulary(system_patterns={"ALPHA": "alpha"})
    path = str(tmp_path / "cat")

    def recogniser():
        return lambda image: "broom seal" if image.endswith("p002.png") else ""

    def encoder():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    regions = table("image_key long, region_no long, vec doubles", [(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 0, [0.6, 0.8])])
    hashes = table("image_key long, phash long", [(1, 5), (2, 9)])
    tables = build(path, pages, "/in", cells, photos, vocabulary, recogniser, encoder, regions, hashes)
    assert sorted(map(tuple, tables["descriptors"].collect())) == [(1, 5), (2, 9)]
    got = sorted(tables["pages"].collect(), key=lambda r: r.page_id)
    assert [(r.page_id, r.page_num, r.system, r.doc_kind, r.ocr_text, r.refs) for r in got] == [
        (1, 1, "ALPHA", "fabrication drawing", "", ["10X2T"]), (2, 2, "ALPHA", "fabrication drawing", "broom seal", []),
        (3, 1, "GENERAL", "product brochure", "", ["10X2T"])]
    assert [r.ref for r in sorted(tables["parts"].collect(), key=lambda r: r.part_id)] == ["10X2-T", "77"]
    for r in tables["page_vectors"].collect():
        assert np.linalg.norm(r.vec) == pytest.approx(1.0, abs=1e-6)

    questions = table("qid int, question string", [(1, "broom seal"), (2, "10x2-t")])
    stored = open_catalogue(spark, path, vocabulary, vectors=True, regions=True)
    near = stored.region_index.nearest(table("qid int, vec doubles", [(1, [0.0, 1.0])]), 2).collect()
    assert [(r.image_key, r.region_no) for r in sorted(near, key=lambda r: r["rank"])] == [(1, 1), (2, 0)]
    dense = stored.vector_index.nearest(stored.page_vectors.select(F.col("page_id").alias("qid"), "vec"), 1).collect()
    assert all(r.cos == pytest.approx(1.0, abs=1e-6) for r in dense) and len(dense) == 3
    hits = rank.search_pages(stored.pages, questions, vocabulary, 3, index=stored.page_index).collect()
    first = {r.qid: r for r in hits if r["rank"] == 1}
    assert first[1].page_id == 2 and first[1].has_ocr and first[1].score == 100
    assert first[2].ref_hit and first[2].page_id in (1, 3)


def test_cache_store_and_lookup(table):
    old = table("key string, answer string, first_inserted_at long", [("a", "1", 1), ("b", "2", 2), ("c", "3", 3)])
    fresh = table("key string, answer string, first_inserted_at long", [("a", "new", 9), ("d", "4", 8)])
    got = {r.key: r.answer for r in cache.store(old, fresh, 3).collect()}
    assert got == {"b": "2", "c": "3", "d": "4"}
    assert {r.key: r.answer for r in cache.store(old, fresh, 4).collect()}["a"] == "new"
    assert cache.store(old, fresh, 0).count() == 0
    asked = table("question string, signature string", [(" Hinge ", "s"), ("hinge", "t")])
    stored = cache.lookup(table("question string, signature string", [("hinge", "s")]),
                          table("key string, answer string", [("x", "y")])).select("key", F.lit("yes").alias("answer"))
    assert sorted(str(r.answer) for r in cache.lookup(asked, stored).collect()) == ["None", "yes"]


def test_inliers_follow_one_projective_map(spark):
    rng = np.random.default_rng(5)
    a = rng.uniform(0, 400, (60, 2))
    h = np.array([[1.1, 0.05, 12], [-0.04, 0.95, -7], [1e-4, 5e-5, 1]])
    mapped = np.column_stack([a, np.ones(60)]) @ h.T
    b = mapped[:, :2] / mapped[:, 2:]
    b[40:] = rng.uniform(0, 400, (20, 2))
    assert 40 <= plugins.inlier_count(a, b) <= 44
    assert plugins.inlier_count(a[:3], b[:3]) == 3
    rows = [(1, *(list(map(float, v)) for v in (a[:, 0], a[:, 1], b[:, 0], b[:, 1]))), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "image_key long, ax array<double>, ay array<double>, bx array<double>, by array<double>")
    got = {r.image_key: r.inliers for r in plugins.verified_inliers(df).collect()}
    assert 40 <= got[1] <= 44 and got[2] == -1


def test_text_encoded_descriptors(table):
    vec = np.array([0.5, -1.25, 3.0], dtype=np.float16)
    text = base64.b64encode(vec.tobytes()).decode()
    df = table("i int, s string", [(0, text), (1, "AAA="), (2, None), (3, "!")])
    got = [r.v for r in df.orderBy("i").select(encodings.half_vector(F.col("s")).alias("v")).collect()]
    assert got[0] == [0.5, -1.25, 3.0] and got[1] in (None, [0.0]) and got[2:] == [None, None]
    number = (1 << 255) | (5 << 64) | 7
    df = table("i int, s string", [(0, format(number, "x")), (1, "zz")])
    words = [r.w for r in df.orderBy("i").select(encodings.hex_words(F.col("s"), 4).alias("w")).collect()]
    assert words == [[-(1 << 63), 0, 5, 7], None]


def test_many_small_rows_are_cut_into_batches(table):
    from plansift.operators.relational import small_batches, union_all
    df = table("qid int, x string", [(i, str(i)) for i in range(50)])
    frames = small_batches(df, "qid", 8)
    assert len(frames) == 7 and sorted(r.qid for r in union_all(frames).collect()) == list(range(50))
