"""The registered queries of the operators, each over its whole table, and their expected results where SQL can give them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm import (
    hard_negatives, html_text, inner_products, language, mixing, near_duplicates, packing, personal_data, quality, spelling, token_counts,
    toxicity, url_filters)
from waybill.llm.common import table

#: Fixed value: the vocabulary the contracts name.
VOCABULARY = "byte_bpe_50k.json"


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_all(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), url_filters.rule_table(spark, url_filters.RULES))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_products.top_products(table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path(VOCABULARY))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Fixed value: labels as the contract of hard negatives has them, some moved to the next one.
MOVED_LABEL = "case when vec_id % 7 = 0 then (label + 1) % 10 else label end"


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", F.expr(MOVED_LABEL)))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_quality": op2_quality,
    "op3_mixing": op3_mixing,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_personal_data": op5_personal_data,
    "op6_url_filters": op6_url_filters,
    "op7_packing": op7_packing,
    "op8_inner_products": op8_inner_products,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_spelling": op12_spelling,
    "op13_html_text": op13_html_text,
}

#: The others learn models, follow a library, or need set comparisons that SQL is too slow for on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op3_mixing": mixing.oracle(),
    "op6_url_filters": url_filters.oracle(),
    "op8_inner_products": inner_products.oracle(),
    "op11_hard_negatives": hard_negatives.oracle(label=MOVED_LABEL),
}
