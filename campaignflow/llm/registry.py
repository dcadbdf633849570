"""Queries over the driver's tables for the text operators, and the DuckDB statements that check them."""

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from campaignflow.llm import attention_lm, conversations, decontaminate, jaccard, language, mixing, pii, quality, substring_dedup, token_counts, token_files, toxicity, vector_codes
from campaignflow.llm.common import documents
from campaignflow.sources.workdir import scratch


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.digest(decontaminate.contamination(documents(spark, sf_dir), benchmark))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(documents(spark, sf_dir), columns=("doc_id", "n_words", "n_removed", "kept_sha256"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_files.write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_tokens(spark, path)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mixture(documents(spark, sf_dir)))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.cumulative(token_counts.histogram(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken")))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.judged(documents(spark, sf_dir)))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.digest(jaccard.joined(documents(spark, sf_dir)))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(documents(spark, sf_dir)))


def op10_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.scored(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.audited(conversations.damaged(rows), known=rows)


QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_substring_dedup, op3_token_files, op4_mixing, op5_language, op6_token_counts, op7_quality, op8_jaccard, op9_pii, op10_attention_lm, op11_toxicity, op12_vector_codes, op13_conversations)} | {"pipeline": corpus_pipeline.run}
ORACLES = {"op1_decontaminate": decontaminate.ORACLE, "op2_substring_dedup": substring_dedup.ORACLE, "op4_mixing": mixing.ORACLE, "op12_vector_codes": vector_codes.ORACLE,
           "op13_conversations": conversations.ORACLE}
