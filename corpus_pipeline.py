"""From raw documents to packed training sequences: five stages, each over all that the last kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm.exact_dedup import keep_first
from tickerloom.llm.near_dedup import keep_one_of_each
from tickerloom.llm.packing import pack_documents
from tickerloom.llm.quality import keep_quality
from tickerloom.llm.queries import word_tokenizer
from tickerloom.llm.secrets import redact
from tickerloom.session import prepare, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word rules and the compression bands."""
    prepare(spark)
    return keep_quality(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    prepare(spark)
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents, the one with the smallest id."""
    prepare(spark)
    return keep_one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark."""
    prepare(spark)
    return redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences."""
    prepare(spark)
    return pack_documents(docs, word_tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has neither zstandard nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents through all stages. Each result is a table in the shared folder before the next
    stage begins, so a lost executor costs no more than its own stage."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark, "pipeline", uuid.uuid4().hex)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
