"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, packing, pii, piece_sampling, quality_model, quality_rules, secret_scan, simhash, substring, token_files


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(_docs(spark, sf_dir))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_digest(_docs(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digest(_docs(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(_docs(spark, sf_dir))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.piece_digest(_docs(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, sf_dir), with_ids=False)


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_digest(_docs(spark, sf_dir))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda vec_id: vec_id % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secrets, op2_substring, op3_quality, op4_tokens, op5_simhash, op6_pii, op7_pieces, op8_packing, op9_rules, op10_neighbours)}


#: op9's base is expressible apart from its verdict, the others are tested against brute force.
def oracle_sql() -> dict[str, str]:
    return {}
