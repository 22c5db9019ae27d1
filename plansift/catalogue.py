"""The tables of a catalogue.

Nested values are native: arrays for systems, references and vectors, structs for
boxes.  Pages carry the columns of their document, so ranking never joins page
text to a second large table.

pages       page_id, doc_id, page_num, text, ocr_text, summary, refs[], filename,
            title, system, systems[], doc_kind
documents   doc_id, filename, title, system, systems[], doc_kind, num_pages
figures     figure_id, page_id, kind, filename, thumb, width, height, area, box
parts       part_id, ref, ref_norm, kind, supplier_ref, designation
ref_images  image_id, ref, ref_norm, filename
ocr_boxes   box_id, page_id, text, box
page_vectors page_id, vec
"""
from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from plansift.vocab import Vocabulary


@dataclass(frozen=True)
class Catalogue:
    pages: DataFrame
    documents: DataFrame | None = None
    figures: DataFrame | None = None
    parts: DataFrame | None = None
    ref_images: DataFrame | None = None
    ocr_boxes: DataFrame | None = None
    page_vectors: DataFrame | None = None
    #: ``text_index.TextIndex`` over the pages and over the parts, where they are stored
    page_index: Any = None
    part_index: Any = None
    #: ``ref_norm, page_id`` as ``parts.reference_list`` gives it
    ref_pages: DataFrame | None = None
    #: ``vector_index.VectorIndex`` over the page vectors and over the region vectors of images
    vector_index: Any = None
    region_index: Any = None
    vocabulary: Vocabulary = field(default_factory=Vocabulary)


def with_document_columns(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Copy the document columns onto every page (done once, when building)."""
    columns = ["filename", "title", "system", "systems", "doc_kind"]
    return pages.join(documents.select("doc_id", *columns), "doc_id")


def page_title_text() -> Column:
    """Title as indexed: title, systems and kind together."""
    return F.concat_ws(" ", "title", F.array_join("systems", " "), "doc_kind")
