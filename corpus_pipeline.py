"""Documents from language check to packed training sequences; see STAGES."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm import language, mixing, near_duplicates, packing, personal_data
from waybill.llm.common import staged, table
from waybill.llm.queries import VOCABULARY

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Texts whose best language has less than this probability are rejected, and texts unfamiliar to all languages.
LEAST_SCORE = 0.5
#: Words of a shingle, and the similarity in percent from which documents are near-duplicates.
SHINGLE, SIMILAR = 5, 80


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the model knows; it is trained on this stage's input."""
    rows = docs.select(F.struct("*").alias("row"))
    judged = rows.withColumn("judged", language.judge(spark, language.train(docs))("row.text"))
    kept = (F.col("judged.lang_pred") != language.UNKNOWN) & F.col("judged.familiar") & (F.col("judged.score") >= LEAST_SCORE)
    return judged.where(kept).select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    gone = near_duplicates.near_duplicates(docs, SHINGLE, SIMILAR).where("not kept").select("doc_id", "text_hash").distinct()
    rows = docs.select(F.struct("*").alias("row"))
    return rows.join(gone, F.expr("cast(row.doc_id as long) <=> doc_id and xxhash64(row.text) = text_hash"), "left_anti").select("row.*")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data in their texts is replaced by its kind."""
    return personal_data.redacted(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of all sources at their target weights; some are left out, some come twice."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, with its sequence and offset."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES: list[tuple[str, Stage]] = [
    ("language", in_a_language),
    ("near-duplicates", without_near_duplicates),
    ("personal data", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

#: The first stage learns a model and the last follows a tokenizer, so SQL can't give the result; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
