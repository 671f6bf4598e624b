"""From raw documents to packed training sequences, one operator of the llm subpackage a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from omiclattice.llm import decontaminate, near_join, packing, pii, quality
from omiclattice.llm.storage import settle


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier accepts (7)."""
    column = "__quality"
    return quality.scored(docs, quality.fit(docs), column=column).where(F.col(column) >= 0.5).drop(column)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (6): five-word shingles, Jaccard 0.8 or more; the smallest doc_id stays.

    Rows of one doc_id are one document. Rows with a null doc_id stay.
    """
    found = near_join.classes_of(docs, settle(near_join.signatures(docs, size=5)), size=5, percent=80)
    gone = found.where("node <> component").select(F.col("node").alias("__gone"))
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage (1)."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked (5); n_chars follows the text."""
    return pii.masked(docs, pii.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents packed into sequences of 2048 tokens (10)."""
    return packing.pack_documents(docs)


STAGES = [("quality", keep_quality), ("near duplicates", keep_distinct), ("decontamination", drop_leaks), ("personal data", mask_personal), ("packing", pack)]

#: The stages train models and search windows: SQL can't express them; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
