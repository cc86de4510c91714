"""One query for each operator, on the whole of the table it is meant for, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.llm import bpe_roundtrip, chat_transcript, decontaminate, drift_kmeans, grace_dedup, jaccard_join, language_id, line_quality, lm_score, oracles, quality_rules, secret_scan, spelling, token_count
from voxtable.llm.common import read


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(read(spark, sf_dir, "documents"), word_bpe()).withColumn("over_limit", F.col("n_tokens") > 2048)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents")).withColumn("failed", F.array_join("failed", ","))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(read(spark, sf_dir, "documents"), word_order=3, word_mass=64.0)


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_transcript.chat_formatting(read(spark, sf_dir, "conversations"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(read(spark, sf_dir, "documents"))


def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_roundtrip.bpe_roundtrip(read(spark, sf_dir, "documents"), word_bpe())


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents")).drop("text_key")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup.deduplicated(read(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_kmeans.clusters(read(spark, sf_dir, "embeddings")).rows


OPERATORS = (
    op1_token_counts, op2_quality_rules, op3_lm_scores, op4_line_quality, op5_chat_formatting, op6_decontamination, op7_language_id, op8_secret_scan,
    op9_bpe_roundtrip, op10_jaccard_join, op11_spelling_variants, op12_exact_dedup, op13_centroid_clustering,
)
QUERIES = {f.__name__: f for f in OPERATORS}
ORACLES = {
    "op2_quality_rules": oracles.OP2, "op6_decontamination": oracles.OP6, "op8_secret_scan": oracles.OP8, "op10_jaccard_join": oracles.OP10,
    "op11_spelling_variants": oracles.OP11, "op12_exact_dedup": oracles.OP12, "op13_centroid_clustering": oracles.OP13,
}
