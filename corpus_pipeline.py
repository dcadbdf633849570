"""Training corpus from raw documents: five stages, each written to the shared folder and read again before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from campaignflow.llm import decontaminate, jaccard, mixing, quality, token_files
from campaignflow.llm.common import documents, written
from campaignflow.sources.workdir import scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighted quality rules accept."""
    return quality.filtered(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group that documents link whose shingles of five words are similar by 80 % or more."""
    return jaccard.representatives(docs, shingle=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are benchmark passages."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: not at all, once, or in several epochs."""
    return mixing.mixed(docs)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' own account of each document, read back from them."""
    path = scratch(spark, "corpus")
    token_files.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_tokens(spark, path)


STAGES = [
    ("quality rules", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_ids),
]

#: The first and the last stage have no SQL form; tests check each stage by itself, the Jaccard stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
