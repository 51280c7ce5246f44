"""The queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, embeddings, hard_negatives, lines, minhash, mixing, pii, quality, resampling, secret_scan, sharding, syncmers, toxicity
from tessera.llm.common import documents


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.scan(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of all documents, decoded again."""
    return bpe.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents' sources takes of each document."""
    return mixing.mix(documents(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secret_scan.scan(documents(spark, sf_dir))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return embeddings.links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity grades of all documents."""
    return toxicity.graded(documents(spark, sf_dir), labels(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return syncmers.fingerprints(documents(spark, sf_dir))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return minhash.classes(documents(spark, sf_dir))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated lines, as digests."""
    return lines.dedup(documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth of all embeddings."""
    return hard_negatives.mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents, drawn by importance towards the benchmark's words."""
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards and slots of all documents."""
    return sharding.sharded(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_pii, op2_quality, op3_bpe, op4_mixing, op5_secrets, op6_embeddings, op7_toxicity, op8_fingerprints, op9_minhash, op10_lines, op11_hard_negatives, op12_resampling, op13_sharding)}
SQL = {"op4_mixing": mixing.SQL, "op10_lines": lines.SQL, "op11_hard_negatives": hard_negatives.SQL, "op12_resampling": resampling.SQL, "op13_sharding": sharding.SQL}
