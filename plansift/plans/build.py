"""Building a catalogue: decoded sources in, stored tables and index out."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plansift import plugins
from plansift.functions import text as T
from plansift.operators import parts as P, rank
from plansift.operators.relational import replace_groups, update_column
from plansift.catalogue import Catalogue
from plansift.sources import index_store, ingest, text_index, vector_index
from plansift.vocab import Vocabulary


def pages_for_recognition(pages: DataFrame, done: DataFrame | None = None, every: bool = False) -> DataFrame:
    """``page_id, image``: pages whose text layer is thin or damaged and not read yet."""
    todo = pages if every else pages.filter(T.needs_ocr(F.col("text"), T.clean_text(F.col("text"))))
    if done is not None:
        todo = todo.join(done.select("page_id"), "page_id", "left_anti")
    return todo.select("page_id", T.page_image(F.col("filename"), F.col("page_num")).alias("image"))


def add_recognised(pages: DataFrame, texts: DataFrame, boxes: DataFrame | None = None,
                   fresh_boxes: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Pages with their recognised text, and boxes with the re-read pages replaced."""
    updated = update_column(pages, "page_id", "ocr_text", texts)
    if boxes is not None and fresh_boxes is not None:
        boxes = replace_groups(boxes, ["page_id"], fresh_boxes)
    return updated, boxes


def page_vectors(pages: DataFrame, factory: Callable[[], plugins.Encoder]) -> DataFrame:
    return plugins.encode(plugins.page_encoding_text(pages), "page_id", "content", factory)


def build(path: str, decoded_pages: DataFrame, root: str, workbook_cells: DataFrame, photos: DataFrame,
          vocabulary: Vocabulary, recogniser: Callable[[], plugins.Recogniser] | None = None,
          encoder: Callable[[], plugins.Encoder] | None = None, regions: DataFrame | None = None,
          descriptors: DataFrame | None = None) -> dict[str, DataFrame]:
    """Write every table and the indexes of pages, parts and vectors below ``path``; returns the tables.

    ``regions`` (``image_key, region_no, vec``) and ``descriptors`` (``image_key`` and bit hashes) of the
    catalogue's images are written with the rest and read back by :func:`open_catalogue`.

    Order matters: parts and photos give the known references, pages are checked
    against them, recognised text arrives before the index and the vectors.
    """
    spark = decoded_pages.sparkSession
    sheet_order = [c for c in ("file", "sheet", "row_no") if c in workbook_cells.columns]
    tables = {
        "parts": ingest.with_ids(ingest.parts_from_cells(workbook_cells), sheet_order, "part_id").drop(*sheet_order),
        "ref_images": ingest.with_ids(ingest.photos_from_files(photos), ["path"], "image_id").select(
            "image_id", "ref", "ref_norm", T.base_name(F.col("path")).alias("filename")),
        "documents": ingest.with_ids(ingest.document_rows(decoded_pages, vocabulary, root), ["filename"], "doc_id")}
    index_store.write_tables(tables, path)
    tables = index_store.read_tables(spark, path, list(tables))
    pages = ingest.build_pages(decoded_pages, tables["documents"], tables["parts"], tables["ref_images"])
    if recogniser is not None:
        index_store.write_tables({"pages_raw": pages}, path)
        pages = spark.read.parquet(f"{path}/pages_raw")
        texts = plugins.recognise(pages_for_recognition(pages), recogniser)
        pages, _ = add_recognised(pages, texts)
    index_store.write_tables({"pages": pages.repartitionByRange("page_id").sortWithinPartitions("page_id")}, path)
    tables["pages"] = spark.read.parquet(f"{path}/pages")
    if encoder is not None:
        index_store.write_tables({"page_vectors": page_vectors(tables["pages"], encoder)}, path)
        tables["page_vectors"] = spark.read.parquet(f"{path}/page_vectors")
        vector_index.write_vectors(tables["page_vectors"], f"{path}/page_vector_index")
    if regions is not None:
        vector_index.write_vectors(regions, f"{path}/region_index", keys=("image_key", "region_no"))
    if descriptors is not None:
        index_store.write_tables({"descriptors": descriptors}, path)
        tables["descriptors"] = spark.read.parquet(f"{path}/descriptors")
    index_store.write_tables({"ref_pages": P.reference_list(tables["pages"])}, path)
    tables["ref_pages"] = spark.read.parquet(f"{path}/ref_pages")
    rank.page_index(tables["pages"], f"{path}/page_index")
    P.part_index(tables["parts"], f"{path}/part_index")
    return tables


def open_catalogue(spark: SparkSession, path: str, vocabulary: Vocabulary, vectors: bool = False, regions: bool = False) -> Catalogue:
    """The catalogue written by :func:`build`, with its indexes; ``vectors`` and ``regions`` say what was built besides."""
    names = ["pages", "documents", "parts", "ref_images", "ref_pages", *(["page_vectors"] if vectors else [])]
    return Catalogue(**index_store.read_tables(spark, path, names), vocabulary=vocabulary,
                     page_index=text_index.TextIndex(spark, f"{path}/page_index"),
                     part_index=text_index.TextIndex(spark, f"{path}/part_index"),
                     vector_index=vector_index.VectorIndex(spark, f"{path}/page_vector_index") if vectors else None,
                     region_index=vector_index.VectorIndex(spark, f"{path}/region_index") if regions else None)
