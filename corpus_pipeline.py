"""Corpus preparation in five stages, each written as Parquet and read again.

Quality rules drop documents; near-duplicates leave one document of each
class; repeated 100-byte strings, then benchmark passages, are cut out of the
texts; byte-level BPE turns the rest into ids.  All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.llm import bpe, decontaminate, near_duplicates, quality_rules, suffix_dedup
from beatloom.llm.store import prepare, read, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_rules.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_duplicates.distinct_documents(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return suffix_dedup.clean(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    tokenizer = bpe.Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), tokenizer)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encoding),
]
# BPE and the verified near-duplicate classes have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
