"""Catalogue views over the driver tables.

documents -> pages and documents, part -> parts, lineitem -> part photos and
figures, embeddings -> vectors.  Every view covers its whole table.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from plansift.catalogue import Catalogue
from plansift.functions import refs as R
from plansift.operators import parts as P, rank
from plansift.sources import text_index, vector_index
from plansift.staging import stage, staging_root
from plansift.vocab import Vocabulary

VOCABULARY = Vocabulary(
    system_aliases={"SRC1": ("src1 ", "first source"), "SRC2": ("src2 ", "second source"),
                    "SRC7": ("src7 ", "seventh source")},
    system_patterns={"EVEN SOURCE": r"src\d?[02468]$", "ODD SOURCE": r"src\d?[13579]$"},
    system_words=("first", "second", "seventh", "source"),
    system_codes=("70TH", "45TH", "70", "45"),
    prompts=("Ring plates", "Which rods fit 143?", "Small anvil sizes"),
    contents_markers=("schematic cross-sections", "contents", "pages 50-51", "pages 52-53"),
    divider_marker="schematic cross-sections",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Distribute a table stored in fewer files than there are cores.

    A file with one row group is one task however large its text; with many
    files the table is left as stored.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(
        F.col("doc_id").alias("page_id"),
        F.concat_ws("-", "source", "lang").alias("doc_id"),
        F.col("doc_id").cast("int").alias("page_num"),
        "text", F.lit("").alias("ocr_text"), F.lit("").alias("summary"),
        F.array().cast("array<string>").alias("refs"),
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit(" notes.pdf")).alias("filename"),
        F.concat(F.upper("source"), F.lit(" — "), F.col("lang"), F.lit(" notes")).alias("title"),
        F.upper("source").alias("system"), F.array(F.upper("source")).alias("systems"),
        F.col("lang").alias("doc_kind"))


_INDEXES: dict[tuple[str, str, str], text_index.TextIndex | vector_index.VectorIndex | DataFrame] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, build) -> text_index.TextIndex:
    """The index of a folder's table, built at its first use by an application."""
    place = (spark.sparkContext.applicationId, sf_dir, name)
    if place not in _INDEXES:
        _INDEXES[place] = build()
    return _INDEXES[place]


def page_index(spark: SparkSession, sf_dir: str) -> text_index.TextIndex:
    return _stored(spark, sf_dir, "pages", lambda: rank.page_index(pages(spark, sf_dir)))


def pages_with_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages that carry the references they name."""
    place = (spark.sparkContext.applicationId, sf_dir, "pages with refs")
    if place not in _INDEXES:
        known = P.known_refs(parts(spark, sf_dir), ref_images(spark, sf_dir))
        _INDEXES[place] = stage(P.pages_with_refs(pages(spark, sf_dir), known), "pages-with-refs")
    return _INDEXES[place]


def refs_index(spark: SparkSession, sf_dir: str) -> text_index.TextIndex:
    return _stored(spark, sf_dir, "refs index", lambda: rank.page_index(pages_with_refs(spark, sf_dir)))


def part_index(spark: SparkSession, sf_dir: str) -> text_index.TextIndex:
    return _stored(spark, sf_dir, "parts", lambda: P.part_index(parts(spark, sf_dir)))


def ref_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored list of pages by reference."""
    place = (spark.sparkContext.applicationId, sf_dir, "refs")
    if place not in _INDEXES:
        known = P.known_refs(parts(spark, sf_dir), ref_images(spark, sf_dir))
        _INDEXES[place] = stage(P.reference_list(pages(spark, sf_dir), known), "ref-pages")
    return _INDEXES[place]


def vectors_on_disk(spark: SparkSession, sf_dir: str) -> vector_index.VectorIndex:
    place = (spark.sparkContext.applicationId, sf_dir, "vectors")
    if place not in _INDEXES:
        path = f"{staging_root(spark)}/vector-index-{uuid.uuid4().hex}"
        vector_index.write_vectors(page_vectors(spark, sf_dir), path)
        _INDEXES[place] = vector_index.VectorIndex(spark, path)
    return _INDEXES[place]


def capital_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages set in capitals with one clause per line, the form headings come in."""
    clauses = F.regexp_replace("text", r"[.,!?]+\s*", "\n")
    return pages(spark, sf_dir).withColumn("text", F.upper(clauses))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("num_pages"))
    return p.select(
        F.concat_ws("-", "source", "lang").alias("doc_id"),
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit(" notes.pdf")).alias("filename"),
        F.concat(F.upper("source"), F.lit(" — "), F.col("lang"), F.lit(" notes")).alias("title"),
        F.upper("source").alias("system"), F.array(F.upper("source")).alias("systems"),
        F.col("lang").alias("doc_kind"), "num_pages")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part, and a second listing under another name for the small sizes."""
    part = table(spark, sf_dir, "part")
    ref = F.concat(F.col("p_partkey").cast("string"),
                   F.when(F.col("p_size") % 10 == 0, F.lit("-T")).otherwise(F.lit("")))
    kind = (F.when(F.col("p_type").isin("STANDARD", "ECONOMY"), F.lit("profile"))
            .when(F.col("p_type").isin("SMALL", "PROMO"), F.lit("accessory")).otherwise(F.lit("part")))
    name = F.concat(F.upper("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit("mm: "), F.col("p_brand"))
    swapped = F.concat(F.split("p_name", " ")[1], F.lit(" "), F.split("p_name", " ")[0])
    first = F.struct((F.col("p_partkey") * 2).alias("part_id"), kind.alias("kind"), name.alias("designation"))
    second = F.struct((F.col("p_partkey") * 2 + 1).alias("part_id"), F.lit("accessory").alias("kind"),
                      F.upper(swapped).alias("designation"))
    listed = part.select(ref.alias("ref"), F.col("p_brand").alias("supplier_ref"), F.explode(
        F.when(F.col("p_size") <= 10, F.array(first, second)).otherwise(F.array(first))).alias("row"))
    return listed.select("row.part_id", "ref", R.norm_ref(F.col("ref")).alias("ref_norm"), "row.kind",
                         "supplier_ref", "row.designation")


def ref_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One photo per line item; its reference is three times the part key."""
    li = table(spark, sf_dir, "lineitem")
    ref = (F.col("l_partkey") * 3).cast("string")
    return li.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("image_id"), ref.alias("ref"),
        R.norm_ref(ref).alias("ref_norm"),
        F.concat(F.lit("photo_"), F.col("l_orderkey").cast("string"), F.lit("_"),
                 F.col("l_linenumber").cast("string"), F.lit(".jpg")).alias("filename"))


def figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("fig_"), F.col("l_orderkey").cast("string"), F.lit("_"),
                    F.col("l_linenumber").cast("string"))
    return li.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("figure_id"),
        F.col("l_orderkey").alias("page_id"),
        F.when(F.col("l_returnflag") == "R", F.lit("drawing")).otherwise(F.lit("raster")).alias("kind"),
        F.concat(name, F.lit(".png")).alias("filename"), F.concat(name, F.lit("_thumb.png")).alias("thumb"),
        F.col("l_extendedprice").alias("area"),
        F.struct((F.col("l_discount") * 4).alias("x0"), (F.col("l_tax") * 4).alias("y0"),
                 (F.col("l_discount") * 4 + F.col("l_quantity") / 100).alias("x1"),
                 (F.col("l_tax") * 4 + F.col("l_quantity") / 80).alias("y1")).alias("box"))


def ocr_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box per text line, placed by its order on the page."""
    docs = spread(table(spark, sf_dir, "documents"))
    rows = docs.select(F.col("doc_id").alias("page_id"), F.split("text", "\n").alias("lines")).select(
        "page_id", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "text"))
    return rows.select(
        (F.col("page_id") * 100000 + F.col("pos")).alias("box_id"), "page_id", "text",
        F.struct(F.lit(0.05).alias("x"), F.round(F.col("pos") / F.col("n"), 5).alias("y"),
                 F.round(F.least(F.length("text") / 1000.0, F.lit(0.9)), 5).alias("w"),
                 F.round(F.lit(1.0) / F.col("n"), 5).alias("h")).alias("box"))


def page_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("page_id"), F.col("embedding").alias("vec"), "label")


def catalogue(spark: SparkSession, sf_dir: str) -> Catalogue:
    return Catalogue(
        pages=pages(spark, sf_dir), documents=documents(spark, sf_dir), figures=figures(spark, sf_dir),
        parts=parts(spark, sf_dir), ref_images=ref_images(spark, sf_dir),
        ocr_boxes=ocr_boxes(spark, sf_dir), page_vectors=page_vectors(spark, sf_dir),
        page_index=page_index(spark, sf_dir), part_index=part_index(spark, sf_dir),
        vector_index=vectors_on_disk(spark, sf_dir), ref_pages=ref_pages(spark, sf_dir),
        vocabulary=VOCABULARY)
