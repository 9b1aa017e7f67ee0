"""Stages of a corpus pipeline: functions of (spark, docs, sf_dir) over the columns of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, line_dedup, mixing, packing, quality


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars as the texts are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line marks reject go; the field is fitted on the documents at hand."""
    field = quality.fit_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, field).where("kept").select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go from the texts."""
    return _counted(line_dedup.dedup_lines(docs).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 or more on 5-word shingles tie together, the one with the smallest id stays."""
    found = jaccard.similar_components(docs, words=5, num=80, den=100)
    others = found.where("key <> component_id").select(F.col("key").alias("doc_id"))
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each draw of the mix; at the edges of blocks a text is cut to the words drawn."""
    return _counted(mixing.mixed_documents(docs, mixing.mix(docs)))


def token_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, packed."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), literal=False)
