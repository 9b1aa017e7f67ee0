"""Technical indicators and strategy backtests on bars, by instrument.

Bars are few (one a day and instrument), so windows run over an instrument's whole history; ``by`` spreads instruments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..plans.series import decayed_sums, numbered


def _order(by: Sequence[str], order: str) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def _last(n: int, by: Sequence[str], order: str) -> WindowSpec:
    return _order(by, order).rowsBetween(-(n - 1), 0)


def sma(bars: DataFrame, n: int, column: str = "close", out: str | None = None, by: Sequence[str] = (), order: str = "day") -> DataFrame:
    """Simple moving average, null until there are n values."""
    w = _last(n, by, order)
    return bars.withColumn(out or f"sma_{n}", F.when(F.count(column).over(w) >= n, F.avg(column).over(w)))


def ema(bars: DataFrame, columns: dict[str, tuple[str, int]], by: Sequence[str] = (), order: str = "day") -> DataFrame:
    """``bars`` with exponential means: out -> (column, span), of weights (1 - a)^age with a = 2 / (span + 1), divided by
    their sum; nulls are passed over but age the others.

    Numerators and denominators are decayed sums over slices of the history, see series.decayed_sums().
    """
    d = numbered(bars, order, "_i", by)
    for out, (column, span) in columns.items():
        x = F.col(column).cast("double")
        there = F.when(x.isNull(), 0.0).otherwise(1.0)
        d = decayed_sums(d, {"_num": x, "_den": there}, 1 - 2 / (span + 1), by, "_i")
        d = d.withColumn(out, F.when(F.col("_den") > 0, F.col("_num") / F.col("_den"))).drop("_num", "_den")
    return d.drop("_i")


def signal(long: Column, short: Column | None = None) -> Column:
    """1 where ``long`` holds, else -1; with ``short`` 0 where neither does. Unknown conditions don't hold."""
    if short is None:
        return F.when(F.coalesce(long, F.lit(False)), 1).otherwise(-1)
    return F.when(F.coalesce(long, F.lit(False)), 1).when(F.coalesce(short, F.lit(False)), -1).otherwise(0)


def backtest(bars: DataFrame, position: str, column: str = "close", by: Sequence[str] = (), order: str = "day") -> DataFrame:
    """``bars`` with asset_return and strategy_return: products of 1 + change (times the position held, the signal of
    the bar before) less 1, null in the first row; null factors count as 1."""
    w = _order(by, order)
    change = F.col(column) / F.lag(column).over(w) - 1
    d = bars.withColumns({"_change": change, "_held": F.lag(position).over(w)})
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    product = lambda x: F.when(F.col("_change").isNotNull(), F.product(F.coalesce(x, F.lit(0.0)) + 1).over(so_far) - 1)
    return d.withColumns({"asset_return": product(F.col("_change")), "strategy_return": product(F.col("_change") * F.col("_held"))}).drop("_change", "_held")


def macd(bars: DataFrame, fast: int = 12, slow: int = 27, smooth: int = 9, column: str = "close", by: Sequence[str] = (), order: str = "day") -> DataFrame:
    """macd, macd_signal, macd_histogram."""
    d = ema(bars, {"_fast": (column, fast), "_slow": (column, slow)}, by, order).withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    d = ema(d, {"macd_signal": ("macd", smooth)}, by, order)
    return d.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def bollinger(bars: DataFrame, n: int = 20, deviations: float = 2.0, column: str = "close", by: Sequence[str] = (), order: str = "day") -> DataFrame:
    """bb_mid, bb_upper, bb_lower (sample deviation), null until there are n values; bb_signal: above the upper -1, below
    the lower 1, else 0."""
    w = _last(n, by, order)
    full = F.count(column).over(w) >= n
    d = bars.withColumns({"bb_mid": F.when(full, F.avg(column).over(w)), "_sd": F.when(full, F.stddev_samp(column).over(w))})
    d = d.withColumns({"bb_upper": F.col("bb_mid") + deviations * F.col("_sd"), "bb_lower": F.col("bb_mid") - deviations * F.col("_sd")}).drop("_sd")
    return d.withColumn("bb_signal", signal(F.col(column) < F.col("bb_lower"), F.col(column) > F.col("bb_upper")))


def rsi(bars: DataFrame, n: int = 14, column: str = "close", by: Sequence[str] = (), order: str = "day") -> DataFrame:
    """rsi from simple means of gains and losses; the first row's change counts as 0, no loss gives 100, no move null."""
    change = F.coalesce(F.col(column) - F.lag(column).over(_order(by, order)), F.lit(0.0))
    w = _last(n, by, order)
    d = bars.withColumn("_c", change)
    up, down = F.sum(F.greatest(F.col("_c"), F.lit(0.0))).over(w), F.sum(F.greatest(-F.col("_c"), F.lit(0.0))).over(w)
    d = d.withColumns({"_up": up, "_down": down, "_n": F.count("*").over(w)})
    value = F.when(F.col("_down") > 0, 100 - 100 / (1 + F.col("_up") / F.col("_down"))).when(F.col("_up") > 0, 100.0)
    return d.withColumn("rsi", F.when(F.col("_n") >= n, value)).drop("_c", "_up", "_down", "_n")


def rsi_signal(low: float = 30.0, high: float = 70.0) -> Column:
    return signal(F.col("rsi") < low, F.col("rsi") > high)


def confluence(a: Column, b: Column, size: int = 1) -> Column:
    """``size`` times the signal where both agree on a side, else 0."""
    return F.when((a == b) & (a != 0), a * size).otherwise(0)


def crossover_sweep(bars: DataFrame, fast: Sequence[int] = range(3, 50), slow: Sequence[int] = range(4, 50), column: str = "close", by: Sequence[str] = (), order: str = "day") -> DataFrame:
    """fast, slow, final_return of long-or-short crossovers of two simple averages, for every fast < slow, in one plan.

    The averages of every length come from prefix sums of one window; each pair is a group of its own.
    """
    lengths = sorted({*fast, *slow})
    w = _order(by, order)
    d = bars.withColumns({"_row": F.row_number().over(w), "_change": F.col(column) / F.lag(column).over(w) - 1})
    d = d.withColumn("_means", F.create_map(*[x for n in lengths for x in (F.lit(n), F.when(F.col("_row") >= n, F.avg(column).over(_last(n, by, order))))]))
    pairs = F.array(*[F.struct(F.lit(f).alias("fast"), F.lit(s).alias("slow")) for f in fast for s in slow if f < s])
    long = d.select(*by, F.col(order).alias("_o"), "_change", "_means", F.explode(pairs).alias("p")).select(*by, "_o", "_change", "p.fast", "p.slow", (F.col("_means")[F.col("p.fast")] > F.col("_means")[F.col("p.slow")]).alias("above"))
    held = F.lag(signal(F.col("above"))).over(Window.partitionBy(*by, "fast", "slow").orderBy("_o"))
    moved = long.withColumn("_f", 1 + F.coalesce(F.col("_change") * held, F.lit(0.0)))
    return moved.groupBy(*by, "fast", "slow").agg((F.product("_f") - 1).alias("final_return"))


def puell(bars: DataFrame, revenue: str = "revenue", n: int = 365, by: Sequence[str] = (), order: str = "day") -> DataFrame:
    """``bars`` with puell: revenue over its mean of up to n rows."""
    return bars.withColumn("puell", F.try_divide(F.col(revenue), F.avg(revenue).over(_last(n, by, order))))


def distribution(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """mean, median, min, max."""
    return df.groupBy(*by).agg(F.avg(column).alias("mean"), F.percentile(column, F.lit(0.5)).alias("median"), F.min(column).alias("min"), F.max(column).alias("max"))
