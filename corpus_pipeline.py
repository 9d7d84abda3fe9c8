"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor kept and returns a
DataFrame; the driver writes each result as Parquet and reads it again for the next stage.

Edge cases: documents with null or empty text fail the quality rules; rows without doc_id go through every stage but are
no one's copy in near-dedup; repeated rows (equal doc_id and text) stay once after near-dedup; columns beside those of
documents are kept; empty documents give an empty result, an empty benchmark removes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimforge.llm import decontam, lines, mixing, near, quality
from claimforge.llm.common import shared_path, table

#: Near duplicates of the pipeline: five-word shingles, 80 per cent shared.
SHINGLE, SIMILARITY = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.kept(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three-line windows go, and documents of which nothing is left."""
    return lines.deduped(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near.deduped(docs, k=SHINGLE, threshold=SIMILARITY)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document it takes, with its size, target and words taken (repeats counted)."""
    return mixing.mixed(docs)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near", near_stage), ("decontam", decontam_stage), ("mixing", mixing_stage)]

#: Expectation-maximisation, minhash and tiling are not expressible in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
