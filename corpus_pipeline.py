"""Cleaning pipeline over `documents`: each stage works on all that the one before kept.

1. language_id: documents whose text is null or has no letter are rejected; the predicted language is set where none is given.
2. near_duplicates: one document (the smallest doc_id) of each group linked by Jaccard similarity of 5-word shingles of 0.8 or more stays.
3. substring_dedup: 13-word windows that also start in a document with a smaller doc_id are cut out; documents left without a word go.
4. decontamination: documents that hold a benchmark item go.
5. encode: the ids of each text that is left, and the bytes they decode to as a digest.

Columns other than those of `documents` are left out; an empty table goes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wfspark.llm.bpe import bpe_encode
from wfspark.llm.decontamination import decontamination
from wfspark.llm.jaccard_join import Similarity, jaccard_join
from wfspark.llm.language_id import UNKNOWN, language_id, train
from wfspark.llm.sources import discard, table, written
from wfspark.llm.substring_dedup import substring_dedup

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every labelled document teaches the model; what it takes for no language at all is rejected, and documents without a language get the predicted one.
    Without any label nothing is learned, so documents are told apart by their letters only and keep a null language."""
    model = train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    scored = language_id(docs, model, carry=("text", "lang", "source", "n_chars"))
    return scored.where(F.col("lang_pred") != UNKNOWN).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that share a doc_id the one with the least text stays; rows without a doc_id or without a word are like nothing and stay."""
    named = docs.where("doc_id is not null").select(*COLUMNS)
    twice = named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    if twice:
        rest = [c for c in COLUMNS if c != "doc_id"]
        named = named.groupBy("doc_id").agg(F.min(F.struct(F.col("text").isNull().alias("none"), *sorted(rest, key=lambda c: c != "text"))).alias("row")).select("doc_id", *[f"row.{c}" for c in rest]).select(*COLUMNS)
    first = jaccard_join(named, Similarity(n=5, percent=80)).where("doc_id = component_id").select("doc_id")
    return named.join(first, "doc_id", "left_semi").select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """White space stays as it was around the words that are left; documents that had no word stay."""
    cut = substring_dedup(docs, carry=("lang", "source")).where("n_words > n_removed or n_words = 0")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a doc_id can't be named by a finding and stay; without a benchmark all rows stay."""
    leaks = decontamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the whole text, how many they are, and the digest of the bytes that they decode to; every row is encoded."""
    encoded = bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", decontaminate),
    ("encode", encode),
]

#: SQL has no naive Bayes, SimHash or byte-pair merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each result is a table that the next one reads."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
