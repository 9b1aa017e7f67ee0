"""Volume-clock order-flow imbalance (VPIN)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import norm_cdf, student_t_cdf
from ..deploy import ship
from ..plans.scratch import written
from ..plans.series import SLICE_NS, asof, lent_to_next, prefix_sum, previous

WINDOW, SIGMA_WARMUP, PERCENTILE_BINS, PERCENTILE_WARMUP, T_DF = 50, 20, 65_536, 30, 0.25
BUCKETS_PER_DAY = 50
#: Buckets that are ranked in one group, and the cells of values that earlier groups are counted by.
SLICE_BUCKETS, CELLS = 4096, 65_536
_SLICE = "_slice"


def _buy_share(dp: str, sigma: str, dist: str, df: float) -> Column:
    z = f"({dp}) / nullif({sigma}, 0)"
    if dist == "normal":
        share = norm_cdf(z)
    elif dist == "student_t":
        share = student_t_cdf(F.expr(z), df)
    else:
        raise ValueError(f"unknown distribution: {dist!r}")
    return F.when(F.coalesce(F.expr(f"{sigma} > 0"), F.lit(False)), share).otherwise(0.5)


def volume_clock(ticks: DataFrame, bucket_volume: float, by: Sequence[str] = (), slice_ns: int = SLICE_NS) -> DataFrame:
    """One row for each tick and bucket that it fills a part of: bucket (from 1), ts_ns, seq, mid, take, closes.

    Bucket k closes at the first tick where the total volume reaches k * bucket_volume; a tick may fill many, and what
    is left opens the next. Ticks without volume take no part. The last, partial bucket's rows have closes false.
    """
    if not bucket_volume > 0:
        raise ValueError("bucket_volume must be above 0")
    v = F.lit(float(bucket_volume))
    t = prefix_sum(ticks.where("volume > 0"), F.col("volume"), "_cum", by, slice_ns).withColumn("_before", F.col("_cum") - F.col("volume"))
    first, last = F.floor(F.col("_before") / v).cast("long") + 1, F.ceil(F.col("_cum") / v).cast("long")
    t = t.withColumn("bucket", F.explode(F.sequence(first, F.greatest(first, last))))
    take = F.least(F.col("_cum"), F.col("bucket") * v) - F.greatest(F.col("_before"), (F.col("bucket") - 1) * v)
    return t.withColumns({"take": take, "closes": F.col("_cum") >= F.col("bucket") * v}).drop("_cum", "_before")


def buckets(
    ticks: DataFrame,
    bucket_volume: float,
    dist: str = "normal",
    df: float = T_DF,
    granularity: str = "bucket",
    sigma: float | None = None,
    sigma_warmup: int = SIGMA_WARMUP,
    by: Sequence[str] = (),
    slice_ns: int = SLICE_NS,
) -> DataFrame:
    """Closed buckets: bucket, ts_end, price_end, dp, v_buy, v_sell, order_imbalance, warmup.

    ``sigma`` None takes the population deviation of earlier price changes (of buckets, or of ticks with granularity
    'tick'); a number is used as it is. Closed buckets are written as a table once; windows over them run in slices of
    SLICE_BUCKETS, whose first bucket gets the last price before it and whose totals come from a table of one row a slice.
    """
    v = F.lit(float(bucket_volume))
    if granularity == "bucket":
        first = ticks.groupBy(*by).agg(F.min_by("mid", F.struct("ts_ns", "seq")).alias("_first"))
        b = volume_clock(ticks, bucket_volume, by, slice_ns).where("closes").select(*by, "bucket", F.col("ts_ns").alias("ts_end"), F.col("mid").alias("price_end"))
        b = _price_changes(written(b, "buckets"), by)
        b = b.join(first, list(by)) if by else b.crossJoin(F.broadcast(first))
        b = b.withColumn("dp", F.coalesce("dp", F.col("price_end") - F.col("_first"))).drop("_first")
        if sigma is None:
            b = _earlier_deviation(b, by)
        else:
            b = b.withColumns({"_sigma": F.lit(float(sigma)), "_n": F.lit(0).cast("long")})
        b = b.withColumn("v_buy", v * _buy_share("dp", "_sigma", dist, df))
        warm = F.col("_n") < sigma_warmup
    elif granularity == "tick":
        t = previous(ticks, {"_last": "mid"}, by, slice_ns).where("volume > 0").withColumn("dp", F.col("mid") - F.col("_last"))
        for name, value in (("_n", F.when(F.col("dp").isNotNull(), 1).otherwise(0).cast("long")), ("_s1", F.coalesce("dp", F.lit(0.0))), ("_s2", F.coalesce(F.col("dp") * F.col("dp"), F.lit(0.0)))):
            t = prefix_sum(t, value, name, by, slice_ns).withColumn(name, F.col(name) - value)
        spread = F.when(F.col("_n") >= 2, F.sqrt(F.greatest(F.lit(0.0), F.col("_s2") / F.col("_n") - (F.col("_s1") / F.col("_n")) * (F.col("_s1") / F.col("_n"))))).otherwise(0.0) if sigma is None else F.lit(float(sigma))
        t = t.withColumn("_sigma", spread).withColumn("dp", F.coalesce("dp", F.lit(0.0)))
        t = t.withColumn("_share", _buy_share("dp", "_sigma", dist, df))
        parts = volume_clock(t, bucket_volume, by, slice_ns)
        closing = F.when(F.col("closes"), F.struct("ts_ns", "mid", "_n"))
        b = parts.groupBy(*by, "bucket").agg(F.sum(F.col("take") * F.col("_share")).alias("v_buy"), F.max(closing).alias("_c")).where("_c is not null")
        b = b.select(*by, "bucket", F.col("_c.ts_ns").alias("ts_end"), F.col("_c.mid").alias("price_end"), "v_buy", F.col("_c._n").alias("_n"))
        b = _price_changes(written(b, "buckets"), by)
        warm = F.col("_n") < sigma_warmup
    else:
        raise ValueError(f"unknown granularity: {granularity!r}")
    b = b.withColumn("v_sell", v - F.col("v_buy")).withColumn("order_imbalance", F.abs(F.col("v_buy") - F.col("v_sell")) / v)
    b = b.withColumn("warmup", warm if sigma is None else F.lit(False))
    return b.select(*by, "bucket", "ts_end", "price_end", "dp", "v_buy", "v_sell", "order_imbalance", "warmup")


def _price_changes(closed: DataFrame, by: Sequence[str]) -> DataFrame:
    """``closed`` with dp: its price less the one of the bucket before, null for the first."""
    d = lent_to_next(closed, "bucket", SLICE_BUCKETS, 1)
    return d.withColumn("dp", F.col("price_end") - F.lag("price_end").over(Window.partitionBy(*by, _SLICE).orderBy("bucket"))).where("NOT _lent").drop("_lent", _SLICE)


def _earlier_deviation(b: DataFrame, by: Sequence[str]) -> DataFrame:
    """``b`` with _n and _sigma: how many earlier buckets there are and the population deviation of their dp, 0 under two.

    Within a slice both come from a window; earlier slices add their count, sum and squares about their mean.
    """
    d = b.withColumn(_SLICE, F.floor((F.col("bucket") - 1) / SLICE_BUCKETS).cast("long"))
    own = d.groupBy(*by, _SLICE).agg(F.count("dp").alias("_m"), F.avg("dp").alias("_mean"), F.var_pop("dp").alias("_var"))
    lower = Window.partitionBy(*by).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(lower), F.lit(0.0))
    before = own.select(
        *by,
        _SLICE,
        total(F.col("_m").cast("double")).alias("_bn"),
        total(F.col("_m") * F.col("_mean")).alias("_bs"),
        total(F.col("_m") * (F.col("_var") + F.col("_mean") * F.col("_mean"))).alias("_bq"),
    )
    w = Window.partitionBy(*by, _SLICE).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({"_wn": F.count("dp").over(w).cast("double"), "_wm": F.coalesce(F.avg("dp").over(w), F.lit(0.0)), "_wv": F.coalesce(F.var_pop("dp").over(w), F.lit(0.0))})
    d = d.join(before, [*by, _SLICE])
    n = F.col("_bn") + F.col("_wn")
    mean_before = F.coalesce(F.try_divide("_bs", "_bn"), F.lit(0.0))
    apart = F.col("_wm") - mean_before
    squares = F.greatest(F.col("_bq") - F.col("_bs") * mean_before, F.lit(0.0)) + F.col("_wn") * F.col("_wv") + apart * apart * F.col("_bn") * F.col("_wn") / F.nullif(n, F.lit(0.0))
    d = d.withColumns({"_n": n.cast("long"), "_sigma": F.when(n >= 2, F.sqrt(F.greatest(squares, F.lit(0.0)) / n)).otherwise(0.0)})
    return d.drop(_SLICE, "_bn", "_bs", "_bq", "_wn", "_wm", "_wv")


def rolling(closed: DataFrame, window: int = WINDOW, by: Sequence[str] = ()) -> DataFrame:
    """``closed`` with vpin: the mean imbalance of the last ``window`` buckets, null until there are so many.

    Slices of buckets are averaged apart; the last window - 1 buckets of each are lent to the next.
    """
    d = lent_to_next(closed, "bucket", max(SLICE_BUCKETS, window), window - 1)
    w = Window.partitionBy(*by, _SLICE).orderBy("bucket").rowsBetween(-(window - 1), 0)
    d = d.withColumn("vpin", F.when(F.count("*").over(w) >= window, F.avg("order_imbalance").over(w)))
    return d.where("NOT _lent").drop("_lent", _SLICE)


def ranks_so_far(values: np.ndarray, block: int = 512) -> np.ndarray:
    """For each value, how many of the values up to it, itself included, are at or below it; nan ranks and counts 0."""
    out = np.zeros(len(values), np.int64)
    for a in range(0, len(values), block):
        b = min(a + block, len(values))
        below = values[None, :b] <= values[a:b, None]
        out[a:b] = (below & (np.arange(b)[None, :] <= np.arange(a, b)[:, None])).sum(axis=1)
    return out


def percentile(readings: DataFrame, warmup: int = PERCENTILE_WARMUP, bins: int | None = None, by: Sequence[str] = (), slice_buckets: int = SLICE_BUCKETS) -> DataFrame:
    """``readings`` with vpin_pctile: the share of readings so far at or below the present one, itself included; null
    for the first warmup - 1. ``bins`` counts in so many equal steps of [0, 1], as the streaming engine does.

    Readings are written as a table once and cut into slices of so many buckets. A slice's own readings are ranked in a
    group of that size; those of earlier slices are counted in pairs of slices, see _earlier(). Null and NaN readings
    count for nothing and come out null.
    """
    ship(readings.sparkSession)
    known = F.col("vpin").isNotNull() & ~F.isnan("vpin")
    value = F.least(F.floor(F.col("vpin") * bins), F.lit(bins - 1)).cast("double") if bins else F.col("vpin")
    d = written(readings.withColumns({_SLICE: F.floor(F.col("bucket") / slice_buckets).cast("long"), "_v": F.when(known, value)}), "readings")
    schema = d.withColumns({"_own": F.lit(0).cast("long"), "_seen": F.lit(0).cast("long")}).schema

    def rank(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bucket")
        values = rows["_v"].to_numpy(np.float64, na_value=np.nan)
        return rows.assign(_own=ranks_so_far(values), _seen=np.cumsum(~np.isnan(values)))

    ranked = d.groupBy(*by, _SLICE).applyInPandas(rank, schema)
    ranked = ranked.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("vpin", "_v")})
    sizes = d.groupBy(*by, _SLICE).agg(F.count("_v").alias("_n"))
    before = sizes.select(*by, _SLICE, F.sum("_n").over(Window.partitionBy(*by).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    both = ranked.join(before, [*by, _SLICE])
    if d.select(_SLICE).distinct().limit(2).count() > 1:
        both = both.join(_earlier(d, bins or 1, by), [*by, _SLICE, "_v"], "left")
    else:
        both = both.withColumn("_earlier", F.lit(0).cast("long"))
    seen = F.col("_seen") + F.coalesce("_before", F.lit(0))
    share = (F.col("_own") + F.coalesce("_earlier", F.lit(0))) / seen
    return both.withColumn("vpin_pctile", F.when(F.col("_v").isNotNull() & (seen >= warmup), share)).select(*readings.columns, "vpin_pctile")


def _earlier(d: DataFrame, scale: int, by: Sequence[str]) -> DataFrame:
    """by, _slice, _v and _earlier: the readings of earlier slices at or below a slice's value.

    Slices pair up level by level: at level l, those whose number has bit l set look back at the ones that share the
    higher bits and lack it, so each earlier slice is met at one level. Values lie in [0, scale]. Windows run within a pair's cell of values; a
    table of one row a cell (CELLS at most) carries the counts of lower cells.
    """
    counts = d.where("_v is not null").groupBy(*by, _SLICE, "_v").agg(F.count("*").alias("_n"))
    last = d.agg(F.max(_SLICE).alias("_top"))
    bit = F.expr(f"shiftright({_SLICE}, _level) & 1")
    levels = F.when(F.col("_top") > 0, F.sequence(F.lit(0), F.length(F.bin("_top")) - 1))
    rows = counts.crossJoin(F.broadcast(last)).withColumn("_level", F.explode(levels))
    rows = rows.withColumns({"_pair": F.expr(f"shiftright({_SLICE}, _level + 1)"), "_late": bit == 1, "_cell": F.floor(F.least(F.greatest(F.col("_v") / scale, F.lit(0.0)), F.lit(1.0)) * CELLS).cast("int")})
    pair = [*by, "_level", "_pair"]
    early = F.when(F.col("_late"), 0).otherwise(F.col("_n"))
    lower = Window.partitionBy(*pair).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*pair, "_cell").agg(F.sum(early).alias("_m")).select(*pair, "_cell", F.sum("_m").over(lower).alias("_lower"))
    inside = Window.partitionBy(*pair, "_cell").orderBy("_v").rangeBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_at", F.sum(early).over(inside)).where("_late").join(cells, [*pair, "_cell"])
    return found.groupBy(*by, _SLICE, "_v").agg(F.sum(F.col("_at") + F.coalesce("_lower", F.lit(0))).alias("_earlier"))


def vpin(ticks: DataFrame, bucket_volume: float, window: int = WINDOW, pctile_warmup: int = PERCENTILE_WARMUP, by: Sequence[str] = (), **options) -> DataFrame:
    """buckets(), rolling() and percentile() in a row."""
    return percentile(rolling(buckets(ticks, bucket_volume, by=by, **options), window, by), pctile_warmup, by=by)


def suggest_bucket_volume(ticks: DataFrame, buckets_per_day: int = BUCKETS_PER_DAY, window: int = WINDOW) -> DataFrame:
    """One row: total_volume, days, bucket_volume."""
    days = F.greatest((F.max("ts_ns") - F.min("ts_ns")) / F.lit(86_400e9), F.lit(1e-9))
    d = ticks.agg(F.sum("volume").alias("total_volume"), days.alias("days"))
    return d.withColumn("bucket_volume", F.least(F.col("total_volume") / (F.col("days") * buckets_per_day), F.col("total_volume") / max(50, 8 * window)))


def full_sample_sigma(ticks: DataFrame, bucket_volume: float, by: Sequence[str] = ()) -> DataFrame:
    """One row: sigma, the population deviation of all buckets' price changes, 0 with fewer than two."""
    b = buckets(ticks, bucket_volume, sigma=1.0, by=by)
    return b.groupBy(*by).agg(F.when(F.count("*") >= 2, F.stddev_pop("dp")).otherwise(0.0).alias("sigma"))


def regime(pctile: Column, toxic: float = 0.90, benign: float = 0.35) -> Column:
    return F.when(pctile.isNull() | F.isnan(pctile), "unknown").when(pctile >= toxic, "toxic").when(pctile <= benign, "benign").otherwise("neutral")


def attach(fills: DataFrame, readings: DataFrame, by: Sequence[str] = (), slice_ns: int = SLICE_NS) -> DataFrame:
    """``fills`` with vpin, vpin_pctile and order_imbalance of the last bucket closed at or before each."""
    closed = readings.withColumns({"ts_ns": F.col("ts_end"), "seq": F.col("bucket")})
    return asof(fills, closed, ["vpin", "vpin_pctile", "order_imbalance"], by, slice_ns)
