"""The corpus pipeline: from raw documents to token ids, in stages that each work on all rows the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from voxtable.llm import bpe_roundtrip, decontaminate, jaccard_join, language_id, secret_scan
from voxtable.llm.common import read
from voxtable.llm.queries import word_bpe
from voxtable.session import checkpoint_dir


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: documents that are rejected go."""
    return language_id.kept(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near duplicates one document stays."""
    return jaccard_join.one_of_each(docs)


def without_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a window of a test item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: what it finds is blotted out of the texts; all documents stay."""
    return secret_scan.redacted(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding: doc_id, n_tokens, and digests of the ids and of the decoded text."""
    return bpe_roundtrip.bpe_roundtrip(docs, word_bpe())


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_each),
    ("decontamination", without_tests),
    ("secret_scan", without_secrets),
    ("bpe_roundtrip", encoded),
]

#: SQL can express neither the language model nor the tokenizer; tests/llm/test_pipeline.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is a table in the shared folder of the checkpoints."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
