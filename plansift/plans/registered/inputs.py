"""Question tables used by the registered queries."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plansift.sources import standin

#: questions asked of the whole page table
QUESTIONS = {
    1: "thing erth drawings of doors from src1 source",
    2: "onnd attion erth",
    3: "171 252",
    4: "the ontion",
    5: "stion ring 143 avec pour",
}
#: questions asked of the whole parts table
PART_QUESTIONS = {
    1: "small ring seals",
    2: "anvil 12",
    3: "red widgets and rods",
    4: "sliding doors",
    5: "hardware plate",
}


def question_table(spark: SparkSession, questions: dict[int, str]) -> DataFrame:
    """A local relation, so the optimizer knows how small it is."""
    return spark.createDataFrame(pa.table({
        "qid": pa.array(list(questions), pa.int32()), "question": list(questions.values())}))


def question_values(questions: dict[int, str]) -> str:
    rows = ", ".join("({}::BIGINT, '{}')".format(k, v.replace("'", "''")) for k, v in questions.items())
    return f"asked(qid, question) AS (VALUES {rows})"


def asked_about_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per part, worded six ways."""
    part = standin.spread(standin.table(spark, sf_dir, "part"))
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")

    def text(*bits):
        return F.concat(*[F.lit(b) if isinstance(b, str) else b for b in bits])

    question = (F.when(F.col("p_type") == "STANDARD", text("Which profiles end in ", key, "?"))
                .when(F.col("p_type") == "ECONOMY", text("accessories with ", size, " at the start"))
                .when(F.col("p_type") == "SMALL", text("any reference containing ", key))
                .when(F.col("p_type") == "PROMO", text(key, " ", size, "th"))
                .when(F.col("p_type") == "LARGE", text("show me 3 images of ", F.col("p_name"), "s on ", size,
                                                       " pages for src1 source"))
                .otherwise(text("what is part ", (F.col("p_partkey") * 3).cast("string"), " for, ", size,
                                " mm glasses or drawings?")))
    return part.select(F.col("p_partkey").alias("qid"), question.alias("question"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standin.table(spark, sf_dir, "conversations")
