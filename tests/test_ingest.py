import os
import zipfile

import pytest
from pyspark.sql import functions as F

from plansift.sources import export, index_store, ingest
from plansift.vocab import Vocabulary

VOCAB = Vocabulary(system_patterns={"ALPHA 70TH": r"alph[ae]|70\s*th", "BETA 45TH": r"beta\s*45|45\s*th"})


def test_workbook_columns_are_found_by_name(table):
    cells = table("sheet string, row_no long, cells strings", [
        ("PROFILES 2024", 1, ["printed", None]), ("PROFILES 2024", 2, ["Ref.No.", "Text"]),
        ("PROFILES 2024", 3, ["10x2-t", "Glazing bead"]), ("PROFILES 2024", 4, ["", "skipped"]),
        ("PROFILES 2024", 5, ["5031.0", "", "left", "over"]),
        ("Accessories", 1, ["Item No.", "Supplier No.", "", "Designation"]),
        ("Accessories", 2, ["a1", "s9", "blue", "Seal"]), ("Accessories", 3, ["a2"]),
        ("Empty", 1, ["nothing", "here"])])
    got = sorted((r.sheet, r.ref, r.ref_norm, r.kind, r.supplier_ref, r.designation, r.raw)
                 for r in ingest.parts_from_cells(cells).collect())
    assert got == [
        ("Accessories", "A1", "A1", "accessory", "s9", "Seal", "A1 accessory Seal s9 blue"),
        ("Accessories", "A2", "A2", "accessory", "", "", "A2 accessory"),
        ("PROFILES 2024", "10X2-T", "10X2T", "profile", "", "Glazing bead", "10X2-T profile Glazing bead"),
        ("PROFILES 2024", "5031", "5031", "profile", "", "left - over", "5031 profile left - over")]


def test_ids_follow_the_sort_order(table):
    df = table("a string, b long", [(chr(97 + i % 7), i) for i in range(200)])
    rows = sorted(ingest.with_ids(df, ["a", "b"], "n").collect(), key=lambda r: r.n)
    assert [r.n for r in rows] == list(range(1, 201))
    assert [(r.a, r.b) for r in rows] == sorted((r.a, r.b) for r in rows)


def test_files_to_pages(spark, table, tmp_path):
    root = tmp_path / "pdfs"
    os.makedirs(root / "Alpha range")
    (root / "Alpha range" / "D9100.PDF").write_bytes(b"cover 5031|second page")
    (root / "beta 45 tool.pdf").write_bytes(b"only pages 50-31")
    (root / "notes.txt").write_bytes(b"x")

    def decoder(path, content):
        for i, text in enumerate(content.decode().split("|"), start=1):
            yield {"path": path, "page_num": i, "text": text, "meta_title": "C:\\x\\y.dwg"}

    files = ingest.pdf_files(spark, str(root))
    assert files.count() == 2
    decoded = ingest.decode(files, decoder, "path string, page_num int, text string, meta_title string")
    decoded = decoded.join(files.select("path", "sha1"), "path")
    docs = ingest.with_ids(ingest.document_rows(decoded, VOCAB, str(root)), ["filename"], "doc_id")
    got = {r.filename: (r.title, r.system, r.doc_kind, r.num_pages) for r in docs.collect()}
    assert {os.path.basename(k): v for k, v in got.items()} == {
        "D9100.PDF": ("ALPHA 70TH — D9100", "ALPHA 70TH", "fabrication drawing", 2),
        "beta 45 tool.pdf": ("BETA 45TH — beta 45 tool", "BETA 45TH", "technical catalogue", 1)}
    parts = table("ref_norm string", [("5031",)])
    photos = table("ref_norm string", [("X",)])
    pages = sorted(ingest.build_pages(decoded, docs, parts, photos).collect(), key=lambda r: r.page_id)
    assert [(r.page_id, r.page_num, r.refs) for r in pages] == [(1, 1, ["5031"]), (2, 2, []), (3, 1, [])]


def test_photo_references(spark, tmp_path):
    for name in ("a1-2.JPG", "b.v2.png", "c.txt"):
        (tmp_path / name).write_bytes(b"p")
    rows = ingest.photos_from_files(ingest.photo_files(spark, str(tmp_path))).collect()
    assert sorted((r.ref, r.ref_norm) for r in rows) == [("A1-2", "A12"), ("B.V2", "BV2")]


def test_key_maps_survive_broken_files(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"k1": "v1", "k2": "v2"}')
    (tmp_path / "bad.json").write_text("{not json")
    assert sorted(map(tuple, index_store.read_key_map(spark, str(tmp_path / "good.json")).collect())) == [("k1", "v1"), ("k2", "v2")]
    assert index_store.read_key_map(spark, str(tmp_path / "bad.json")).count() == 0


def test_archive_skips_missing_and_outside_files(spark, table, tmp_path):
    root = tmp_path / "media"
    os.makedirs(root)
    (root / "a.png").write_bytes(b"1")
    (tmp_path / "secret").write_bytes(b"2")
    files = table("filename string", [("a.png",), ("gone.png",), ("../secret",)])
    target = str(tmp_path / "out.zip")
    assert export.zip_files(files, str(root), target, text="hello") == 1
    assert zipfile.ZipFile(target).namelist() == ["answer.txt", "a.png"]


def test_uploads_are_checked(tmp_path):
    assert export.accept_upload("../x/y.PDF", b"1", str(tmp_path)) == str(tmp_path / "y.PDF")
    for name, content in (("y.txt", b"1"), ("y.pdf", b"")):
        with pytest.raises(ValueError):
            export.accept_upload(name, content, str(tmp_path))


def test_tables_round_trip(spark, table, tmp_path):
    df = table("page_id long, vec doubles", [(1, [0.5, 0.25])])
    index_store.write_tables({"pages": df}, str(tmp_path))
    assert index_store.read_tables(spark, str(tmp_path), ["pages"])["pages"].collect() == df.collect()
