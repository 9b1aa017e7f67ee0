"""Properties that VPIN readings must have whatever the data, checked on given ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written
from ..sources.synthetic import split_ticks, trend_ticks
from . import vpin

#: Buckets of the one-sided and the balanced market, and their window.
MARKET_BUCKETS, MARKET_WINDOW, PARTS = 60, 10, 4
SLACK = 1e-12


def analytic_properties(ticks: DataFrame, bucket_volume: float, window: int = 20, slice_ns: int = vpin.SLICE_NS) -> DataFrame:
    """check, passed, detail: volume is conserved, imbalances and readings lie in [0, 1], the first window - 1 readings
    are missing, one-sided flow reads high and balanced flow about 0.5, and cutting each tick in parts changes nothing.

    The two markets have as many ticks as are given. Checks without a reading fail.
    """
    spark = ticks.sparkSession

    def readings(t: DataFrame, volume: float, length: int) -> DataFrame:
        return vpin.rolling(vpin.buckets(t, volume, slice_ns=slice_ns), length)

    own = written(readings(ticks, bucket_volume, window), "readings")
    r = own.agg(
        F.max(F.abs(F.col("v_buy") + F.col("v_sell") - bucket_volume)).alias("lost"),
        F.min("order_imbalance").alias("least"),
        F.max("order_imbalance").alias("most"),
        F.min("vpin").alias("low"),
        F.max("vpin").alias("high"),
        F.count_if(F.col("vpin").isNull()).alias("missing"),
    ).first()
    n = ticks.count()
    level = {}
    for name, drift in (("one-sided", 4e-5), ("balanced", 0.0)):
        market = written(trend_ticks(spark, n, drift=drift), "market")
        volume = market.agg(F.sum("volume")).first()[0]
        level[name] = readings(market, volume / MARKET_BUCKETS, MARKET_WINDOW).agg(F.avg("vpin")).first()[0] if volume else None
    finer = readings(split_ticks(ticks, PARTS), bucket_volume, window)
    both = own.select("bucket", "vpin").join(finer.select("bucket", F.col("vpin").alias("finer")), "bucket")
    same, pairs = both.where("vpin IS NOT NULL AND finer IS NOT NULL").agg(F.corr("vpin", "finer"), F.count("*")).first()

    def text(value: float | None) -> str:
        return "none" if value is None else f"{value:.4f}"

    high, middle = level["one-sided"], level["balanced"]
    checks = [
        ("volume is conserved", r.lost is not None and r.lost <= SLACK * bucket_volume, f"off by {r.lost or 0.0:.3e} at most"),
        ("imbalance in [0, 1]", r.least is not None and r.least >= 0 and r.most <= 1 + SLACK, f"{text(r.least)} to {text(r.most)}"),
        ("vpin in [0, 1]", r.low is not None and r.low >= 0 and r.high <= 1 + SLACK, f"{text(r.low)} to {text(r.high)}"),
        ("vpin warms up", r.missing >= window - 1, f"{r.missing} missing, window {window}"),
        ("one-sided flow reads high", high is not None and high > 0.7, text(high)),
        ("balanced flow reads about 0.5", middle is not None and 0.4 < middle < 0.6, text(middle)),
        ("one-sided above balanced", high is not None and middle is not None and high > middle + 0.2, f"{text(high)}, {text(middle)}"),
        ("unchanged by cut ticks", same is not None and same > 0.95, f"correlation {text(same)} over {pairs} buckets"),
    ]
    return spark.createDataFrame([(name, bool(passed), detail) for name, passed, detail in checks], "check string, passed boolean, detail string")
