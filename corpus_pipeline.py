"""The corpus pipeline: quality rules, near-duplicates, repeated passages, personal data, packing.

Each stage takes all rows that its predecessor kept, written as Parquet and read again. Stages before the last return
the columns of documents, and any others there are, of whatever names and types; ``n_chars`` follows the text where a stage changes it.

Null and empty texts fail the quality rules; a later stage that is given some keeps them. Rows that share an id are documents of their own: of a group of near-duplicates
one row stays, that with the smallest id, of several with that id the one with the smallest hash of its text; a row without an id only if the group has
no other. Texts are taken whole, however long. An empty table gives empty results. The last stage returns the pieces with their token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import packing, pii, quality_rules, simhash, substring
from quire.llm.common import new_folder


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(substring.remove_repeats(docs))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(pii.redact_pii(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", good_quality),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("pii", without_pii),
    ("packing", packed),
]

#: No stage but the second's join is a matter of SQL; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = new_folder(spark, "quire-stage")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
