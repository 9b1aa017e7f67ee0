"""The corpus pipeline: each stage reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowtide.llm import stages
from flowtide.llm.common import documents, written

STAGES = [
    ("quality rules", stages.quality_rules),
    ("line dedup", stages.line_deduplication),
    ("n-gram Jaccard join", stages.near_duplicates),
    ("mixing sources to target weights", stages.source_mix),
    ("packing", stages.token_packing),
]

#: SQL can't express the fitted field, the random mix or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
