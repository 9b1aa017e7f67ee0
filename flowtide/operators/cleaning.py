"""Cleaning of ticks, gaps, bars and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.series import SLICE_NS, prefix_sum, previous, seconds

SPREAD_Z, GAP_SECONDS = 6.0, 300.0


def clean_ticks(ticks: DataFrame, spread_z: float = SPREAD_Z, drop_zero_spread: bool = True, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(clean ticks, report): of equal (ts_ns, bid, ask) the last by seq stays; crossed and, by default, locked quotes go;
    so do log spreads of ``spread_z`` population deviations or more from the mean, where there are more than two ticks,
    all spreads are above 0 and they differ. mid and spread are computed anew. The report counts rows by step.
    """
    w = Window.partitionBy(*by, "ts_ns", "bid", "ask").orderBy(F.desc("seq"))
    unique = ticks.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    spread = F.col("ask") - F.col("bid")
    sound = unique.where(spread > 0 if drop_zero_spread else spread >= 0).withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "spread": spread})
    log_spread = F.log(F.when(F.col("spread") > 0, F.col("spread")))
    stats = sound.groupBy(*by).agg(F.avg(log_spread).alias("_mean"), F.stddev_pop(log_spread).alias("_std"), F.count("*").alias("_rows"), F.min("spread").alias("_least"))
    judged = sound.join(F.broadcast(stats), list(by)) if by else sound.crossJoin(F.broadcast(stats))
    applies = (F.col("_rows") > 2) & (F.col("_least") > 0) & (F.col("_std") > 0)
    clean = judged.where(~applies | (F.abs(log_spread - F.col("_mean")) < spread_z * F.col("_std"))).drop("_mean", "_std", "_rows", "_least")
    n = lambda d, name: d.agg(F.count("*").alias(name))
    counts = n(ticks, "n_input").crossJoin(n(unique, "n_unique")).crossJoin(n(sound, "n_sound")).crossJoin(n(clean, "n_clean"))
    report = counts.select("n_input", (F.col("n_input") - F.col("n_unique")).alias("n_duplicates"), (F.col("n_unique") - F.col("n_sound")).alias("n_crossed"), (F.col("n_sound") - F.col("n_clean")).alias("n_outliers"), "n_clean")
    return clean, report


def flag_gaps(ticks: DataFrame, gap_seconds: float = GAP_SECONDS, by: Sequence[str] = (), slice_ns: int = SLICE_NS) -> DataFrame:
    """``ticks`` with gap_seconds (since the tick before, 0 for the first), gap_flag and session_id (gaps so far)."""
    d = previous(ticks, {"_ts": "ts_ns"}, by, slice_ns)
    d = d.withColumn("gap_seconds", F.coalesce((F.col("ts_ns") - F.col("_ts")) / 1e9, F.lit(0.0))).drop("_ts")
    d = d.withColumn("gap_flag", F.col("gap_seconds") > gap_seconds)
    return prefix_sum(d, F.col("gap_flag").cast("long"), "session_id", by, slice_ns)


def bars(ticks: DataFrame, every_seconds: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """bar_ns, open, high, low, close (of mid), spread (mean), volume (sum); times without ticks have no bar."""
    width = seconds(every_seconds)
    start = (F.floor(F.col("ts_ns") / F.lit(width)) * width).cast("long").alias("bar_ns")
    place = F.struct("ts_ns", "seq")
    return ticks.groupBy(*by, start).agg(F.min_by("mid", place).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", place).alias("close"), F.avg("spread").alias("spread"), F.sum("volume").alias("volume"))


def coverage(ticks: DataFrame, gap_seconds: float = GAP_SECONDS, by: Sequence[str] = (), slice_ns: int = SLICE_NS) -> DataFrame:
    """day, ticks, mean_spread, max_gap_seconds, n_gaps, volume of each UTC day."""
    flagged = flag_gaps(ticks, gap_seconds, by, slice_ns)
    day = F.to_date(F.timestamp_micros(F.floor(F.col("ts_ns") / 1000).cast("long"))).alias("day")
    return flagged.groupBy(*by, day).agg(F.count("*").alias("ticks"), F.avg("spread").alias("mean_spread"), F.max("gap_seconds").alias("max_gap_seconds"), F.count_if("gap_flag").alias("n_gaps"), F.sum("volume").alias("volume"))


