"""Reading a catalogue: files, workbook sheets, part photos; writing its tables.

Decoding PDF pages, workbooks and pixels is left to a decoder the caller supplies
(``binaryFile`` rows in, plain rows out); everything after it is DataFrame work.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plansift.catalogue import with_document_columns
from plansift.functions import refs as R, text as T
from plansift.operators import parts as P
from plansift.vocab import Vocabulary

# fixed values: file suffixes
PDF_SUFFIX = "*.[pP][dD][fF]"
WORKBOOK_SUFFIX = "*.[xX][lL][sS][xXmM]"
PHOTO_SUFFIXES = ("jpg", "jpeg", "png", "gif", "bmp", "webp")


# ---------------------------------------------------------------------------- files
def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", pattern).load(root))


def pdf_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, content, sha1`` of every PDF below ``root``."""
    return _files(spark, root, PDF_SUFFIX).select("path", "content", F.sha1("content").alias("sha1"))


def workbook_files(spark: SparkSession, root: str) -> DataFrame:
    """Every workbook below ``root``; editor lock files (``~$``) are skipped."""
    files = _files(spark, root, WORKBOOK_SUFFIX).select("path", "content")
    return files.filter(~F.startswith(T.base_name(F.col("path")), F.lit("~$")))


def photo_files(spark: SparkSession, root: str) -> DataFrame:
    files = _files(spark, root, "*").select("path", "content")
    return files.filter(F.lower("path").rlike(r"\.(" + "|".join(PHOTO_SUFFIXES) + ")$"))


def decode(files: DataFrame, decoder: Callable[[str, bytes], Iterable[dict]], schema: str) -> DataFrame:
    """Rows of a decoder applied to each file, file by file inside the tasks."""
    columns = [part.strip().split(" ")[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = list(decoder(path, content))
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, schema)


# ------------------------------------------------------------------- workbook sheets
def cell_text(value: Column) -> Column:
    """Cell as text: null is empty, whole numbers lose their fraction."""
    return F.coalesce(F.regexp_replace(F.trim(value.cast("string")), r"^(-?\d+)\.0$", "$1"), F.lit(""))


def _sheet_kind(sheet: Column) -> Column:
    low = F.lower(sheet)
    return (F.when(F.contains(low, F.lit("profile")), F.lit("profile"))
            .when(F.contains(low, F.lit("accessor")), F.lit("accessory")).otherwise(F.lit("part")))


def _last_position(cells: Column, test) -> Column:
    """0-based place of the last cell that passes, or null."""
    places = F.filter(F.transform(cells, lambda c, i: F.when(test(F.lower(c)), i)), lambda i: i.isNotNull())
    return F.array_max(places)


def parts_from_cells(cells: DataFrame) -> DataFrame:
    """Part rows of sheets given as ``[file,] sheet, row_no, cells array<string>``.

    The header is the first row naming a reference or item column; it also tells
    where supplier and description stand (the column after the reference when the
    sheet does not name one).  Rows above it are ignored.
    """
    keys = [c for c in ("file", "sheet") if c in cells.columns]

    def is_ref(c):
        return c.rlike("ref|item")

    def is_supplier(c):
        return ~is_ref(c) & F.contains(c, F.lit("supplier"))

    def is_name(c):
        return ~is_ref(c) & ~F.contains(c, F.lit("supplier")) & c.rlike("design|descri")

    rows = cells.select(*keys, "row_no", F.transform("cells", cell_text).alias("cells"))
    heads = rows.filter(F.exists("cells", lambda c: is_ref(F.lower(c))))
    # one small row per sheet
    header = heads.groupBy(*keys).agg(F.min_by(F.struct("row_no", "cells"), "row_no").alias("head")).select(
        *keys, F.col("head.row_no").alias("head_row"),
        _last_position(F.col("head.cells"), is_ref).alias("ref_at"),
        _last_position(F.col("head.cells"), is_supplier).alias("supplier_at"),
        _last_position(F.col("head.cells"), is_name).alias("name_at"))
    header = header.withColumn("name_at", F.coalesce("name_at", F.col("ref_at") + 1))
    body = rows.join(header, keys).filter(F.col("row_no") > F.col("head_row"))

    def at(position):
        return F.coalesce(F.try_element_at("cells", F.col(position) + 1), F.lit(""))

    body = body.withColumns({"ref": F.upper(at("ref_at")), "supplier_ref": at("supplier_at"), "name": at("name_at"),
                             "kind": _sheet_kind(F.col("sheet"))}).filter(F.col("ref") != "")
    used = F.array_compact(F.array("ref_at", "supplier_at", "name_at"))
    extra = F.filter("cells", lambda c, i: (c != "") & ~F.array_contains(used, i))
    body = body.withColumn("extra", extra)
    borrow = (F.col("name") == "") & (F.size("extra") > 0)
    body = body.withColumn("designation", F.when(borrow, F.array_join("extra", " - ")).otherwise(F.col("name")))
    rest = F.when(borrow, F.array().cast("array<string>")).otherwise(F.col("extra"))
    blob = F.concat(F.array("ref", "kind", "designation", "supplier_ref"), rest)
    return body.select(*keys, "row_no", "ref", R.norm_ref(F.col("ref")).alias("ref_norm"), "kind", "supplier_ref",
                       "designation", F.array_join(F.filter(blob, lambda x: x != ""), " ").alias("raw"))


def photos_from_files(files: DataFrame) -> DataFrame:
    """``path, ref, ref_norm``: a photo's reference is its file stem in capitals; file contents are not read."""
    stem = F.upper(F.trim(F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1)))
    return files.select("path", stem.alias("ref")).withColumn("ref_norm", R.norm_ref(F.col("ref")))


# --------------------------------------------------------------------- ids, documents
def with_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Consecutive ids from 1 in sort order, without a single-task window.

    Rows are range-partitioned and numbered inside each partition; the sizes of the
    preceding partitions (one small row each) are then added.
    """
    from plansift.staging import stage
    placed = df.repartitionByRange(*order).withColumn("part_no", F.spark_partition_id())
    inside = Window.partitionBy("part_no").orderBy(*order)
    numbered = stage(placed.withColumn("row_in_part", F.row_number().over(inside)), "ids")
    sizes = numbered.groupBy("part_no").agg(F.count(F.lit(1)).alias("n"))
    batch = sizes.agg(F.collect_list(F.struct("part_no", "n"))).scalar()
    with_sizes = numbered.withColumn("sizes", batch)
    before = F.aggregate(F.filter("sizes", lambda s: s["part_no"] < F.col("part_no")), F.lit(0).cast("bigint"),
                         lambda acc, s: acc + s["n"])
    return with_sizes.withColumn(name, before + F.col("row_in_part")).drop("sizes", "part_no", "row_in_part")


def document_rows(pages: DataFrame, vocabulary: Vocabulary, root: str) -> DataFrame:
    """Documents of decoded pages ``path, sha1, meta_title, page_num, text``.

    System and kind come from folder and file name; a title that is missing, a file
    path or a file name gives way to the file stem.
    """
    relative = F.regexp_replace("path", "^(file:)?/*" + root.strip("/") + "/", "")
    docs = pages.groupBy("path").agg(F.first("sha1").alias("sha1"), F.first("meta_title").alias("meta_title"),
                                     F.count(F.lit(1)).cast("int").alias("num_pages"))
    docs = docs.withColumn("filename", relative)
    folder = F.when(F.contains("filename", F.lit("/")), F.regexp_extract("filename", "^([^/]+)/", 1)).otherwise(F.lit(""))
    name = T.base_name(F.col("filename"))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    title = F.trim(F.coalesce("meta_title", F.lit("")))
    unusable = (title == "") | F.contains(title, F.lit("\\")) | F.endswith(F.lower(title), F.lit(".pdf"))
    docs = docs.withColumn("system", T.system_of_file(folder, name, vocabulary))
    return docs.select("path", "sha1", "filename", F.concat("system", F.lit(" — "), F.when(unusable, stem).otherwise(title))
                       .alias("title"), "system", F.array("system").alias("systems"), T.kind_of_file(name).alias("doc_kind"),
                       "num_pages", F.current_timestamp().alias("indexed_at"))


def build_pages(pages: DataFrame, documents: DataFrame, parts: DataFrame, ref_images: DataFrame) -> DataFrame:
    """Pages with ids, document columns and the known references they name."""
    keyed = with_ids(pages.join(documents.select("path", "doc_id"), "path"), ["doc_id", "page_num"], "page_id")
    rows = keyed.select("page_id", "doc_id", "page_num", T.strip(F.col("text")).alias("text"),
                        F.lit("").alias("ocr_text"), F.lit("").alias("summary"))
    return P.pages_with_refs(with_document_columns(rows, documents), P.known_refs(parts, ref_images))
