"""Every registered query next to its DuckDB text, on the smallest data set."""
import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from plansift.plans import registered
from plansift.plans.ask import evidence_answer

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query_equals_its_oracle(spark, con, name):
    ok, note = compare(spark, con, name, SF_DIR)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_answers_take_every_route(spark):
    rows = {r.qid: r for r in entry.queries()["answers"](spark, SF_DIR).collect()}
    assert len(rows) == 9
    assert [rows[i].route for i in (1, 2, 3, 8)] == ["greeting", "out_of_scope", "pattern", "not_found"]
    assert rows[7].route == "broad" and rows[7].n_parts == 0
    assert rows[9].n_pages <= 4 and rows[9].n_images <= 3
    assert "Nothing in the indexed catalogues" in rows[8].answer


def test_evidence_text(spark):
    from pyspark.sql import functions as F
    df = spark.sql("""SELECT array(struct('5031' AS ref, 'part' AS kind, '' AS designation, 'p' AS photo)) AS parts,
     array(struct('S' AS system, 'a/b.pdf' AS filename, 3 AS page_num, 'k' AS doc_kind, 'x  y' AS snippet)) AS pages""")
    both = df.select(evidence_answer(F.col("parts"), F.col("pages"))).collect()[0][0].split("\n")
    assert both[:2] == ["**Matching references**",
                        "- **5031** — no description recorded in the workbook (part) · reference photo shown below"]
    assert both[3:5] == ["**Where this is documented**", "- S · b.pdf p.3 (k) — x y"]
    alone = df.select(evidence_answer(F.col("parts"), F.slice("pages", 1, 0))).collect()[0][0]
    assert "No page in the indexed catalogues mentions **5031**" in alone
    none = df.select(evidence_answer(F.slice("parts", 1, 0), F.slice("pages", 1, 0))).collect()[0][0]
    assert none.startswith("I could not find anything")


def test_bundle_text(spark):
    from pyspark.sql import functions as F
    from plansift.plans.ask import bundle_text
    df = spark.sql("""SELECT array(struct('5031' AS ref, 'part' AS kind, '' AS designation)) AS parts,
     array(struct('S' AS system, 'a/b.pdf' AS filename, 3 AS page_num, 'k' AS doc_kind)) AS pages""")
    text = df.select(bundle_text(F.lit("q?"), F.lit(" yes "), F.col("parts"), F.col("pages"))).collect()[0][0]
    assert text.split("\n") == ["Catalogue — q?", "=" * 60, "", "yes", "", "PARTS & ACCESSORIES", "-" * 20,
                                "  5031 (part) — no description on file", "", "SOURCE PAGES", "-" * 20, "  S · b.pdf · p.3 (k)", ""]
    bare = df.select(bundle_text(F.lit("q?"), F.lit(None).cast("string"), F.slice("parts", 1, 0), F.slice("pages", 1, 0)))
    assert bare.collect()[0][0].split("\n") == ["Catalogue — q?", "=" * 60, ""]
