"""Tables that end a lineage, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder on a local master, else one under the warehouse."""
    global _own
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if _own is None:
        _own = tempfile.mkdtemp(prefix="flowtide-")
    return _own


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/flowtide/{name}-{uuid.uuid4().hex}"


#: With it, Spark removes an execution's shuffle files when that ends; where it is unknown, when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table: what reads it often computes it once, and lost executors cost nothing before it. What was
    shuffled for it is removed once it is there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
