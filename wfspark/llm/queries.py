"""The queries of the operators on whole tables, with their production parameters, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wfspark.llm import sql, toxicity
from wfspark.llm.bpe import bpe_encode
from wfspark.llm.decontamination import decontamination
from wfspark.llm.html_extract import html_extract
from wfspark.llm.jaccard_join import jaccard_join
from wfspark.llm.language_id import fold, language_id, train
from wfspark.llm.license_scan import license_scan
from wfspark.llm.quality_rules import quality_rules
from wfspark.llm.sources import table
from wfspark.llm.substring_dedup import substring_dedup
from wfspark.llm.suffix_dedup import suffix_dedup


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold(5) != 0)
    scored = toxicity.toxicity(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), digest=True)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), digest=True)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold(3) != 1))
    return language_id(docs, model).select("doc_id", (fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), digest=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_html_extract": op2_html_extract,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_license_scan": op6_license_scan,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_bpe": op10_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op6_license_scan": sql.license_scan(),
    "op7_substring_dedup": sql.substring_dedup(),
    "op8_quality_rules": sql.quality_rules(),
}
