"""Features of fills from what is known at their time, and counterparty history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import session_label
from ..plans.series import _SLICE, DAY_NS, SLICE_NS, inside, prefix_sum, seconds, sliced

SHORT, LONG, PRIOR_RATE, PRIOR_WEIGHT = 60.0, 900.0, 0.5, 5.0
CORE = ("spread", "obi", "micro_dev", "rv_short", "rv_long", "vol_short", "vol_long", "size_rel_vol", "tick_rate", "spread_mean", "spread_rel", "dt_last_tick", "sec_of_day")
#: Rows of a part that fractional differencing works on at once, at least.
ROWS = 4096
ALL = (*CORE, "vpin", "vpin_pctile", "size", "cp_toxic_rate_hist", "cp_fill_count", "is_client_buy")


def core_features(fills: DataFrame, ticks: DataFrame, short_seconds: float = SHORT, long_seconds: float = LONG, by: Sequence[str] = (), slice_ns: int = SLICE_NS) -> DataFrame:
    """``fills`` with the thirteen features of CORE.

    Windows are [t - width, t] with both ends; the first return in a window reaches back to the tick before it. Without
    a tick at or before the fill all are null; shares with nothing below them are null.

    A sum over a window is the difference of two running sums, at its end and just before its start. So a fill asks at
    three times, and all of them meet the ticks in one pass over slices, whatever the widths; the running sums, the last
    tick and the quote's age come over from earlier slices in a table of one row a slice. Ticks are read twice.
    """
    key = [*by, "fill_id"]
    t = sliced(ticks.select(*by, "ts_ns", "seq", "bid", "ask", "mid", "bid_size", "ask_size", "volume"), slice_ns)
    inside_slice = inside(by)
    back = F.lag(F.struct("mid", "ts_ns")).over(inside_slice)
    per_tick = t.withColumn("_b", back).withColumn("_sq", _square(F.col("mid"), F.col("_b.mid")))
    spread = F.col("ask") - F.col("bid")
    totals = per_tick.groupBy(*by, _SLICE).agg(
        F.sum("_sq").alias("_sq"),
        F.sum("volume").alias("_vol"),
        F.sum(spread).alias("_spr"),
        F.count("mid").alias("_n"),
        F.min_by("mid", F.struct("ts_ns", "seq")).alias("_first"),
        F.max_by(F.struct("bid", "ask", "mid", "bid_size", "ask_size", "ts_ns", F.col("_b.ts_ns").alias("before")), F.struct("ts_ns", "seq")).alias("_last"),
    )
    over = Window.partitionBy(*by).orderBy(_SLICE)
    totals = totals.withColumn("_prev", F.lag("_last").over(over))
    # The first tick of a slice returns from the last one before it, and that one's age may reach a slice further back.
    totals = totals.withColumns(
        {
            "_sq": F.coalesce("_sq", F.lit(0.0)) + F.coalesce(_square(F.col("_first"), F.col("_prev.mid")), F.lit(0.0)),
            "_last": F.col("_last").withField("before", F.coalesce("_last.before", "_prev.ts_ns")),
        }
    )
    carried = totals.select(*by, _SLICE, *[F.sum(c).over(over).alias(c) for c in _RUNNING], "_last")

    probes = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(back_ns).alias("back")) for i, back_ns in enumerate((0, seconds(short_seconds) + 1, seconds(long_seconds) + 1))])
    asked = fills.select(*key, "ts_ns", F.explode(probes).alias("_q"))
    asked = sliced(asked.select(*key, F.col("_q.i").alias("_kind"), (F.col("ts_ns") - F.col("_q.back")).alias("ts_ns")), slice_ns)
    both = t.withColumn("_kind", F.lit(-1)).unionByName(asked, allowMissingColumns=True)
    # Ticks come before the fills of their time; probes have no seq.
    w = Window.partitionBy(*by, _SLICE).orderBy("ts_ns", F.when(F.col("_kind") < 0, 0).otherwise(1), "seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    is_tick = F.when(F.col("_kind") < 0, F.lit(1))
    earlier = F.last(F.when(F.col("_kind") < 0, F.struct("mid", "ts_ns")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("_b", earlier).withColumn("_ret2", F.when(F.col("_kind") < 0, _square(F.col("mid"), F.col("_b.mid"))))
    own = F.when(F.col("_kind") < 0, F.struct("bid", "ask", "mid", "bid_size", "ask_size", "ts_ns", F.col("_b.ts_ns").alias("before")))
    both = both.withColumns(
        {
            "_now": F.last(own, ignorenulls=True).over(so_far),
            "_own_first": F.first(F.when(F.col("_kind") < 0, F.col("mid")), ignorenulls=True).over(so_far),
            "_own_sq": F.sum("_ret2").over(so_far),
            "_own_vol": F.sum("volume").over(so_far),
            "_own_spr": F.sum(spread).over(so_far),
            "_own_n": F.count(is_tick).over(so_far),
        }
    ).where("_kind >= 0")
    found = both.join(_before(asked, carried, by), [*by, _SLICE], "left")
    age = F.col("_now.before")
    found = found.select(
        *key,
        "_kind",
        F.struct(
            (_or_zero("_sq") + _or_zero("_own_sq") + F.coalesce(_square(F.col("_own_first"), F.col("_last.mid")), F.lit(0.0))).alias("sq"),
            (_or_zero("_vol") + _or_zero("_own_vol")).alias("vol"),
            (_or_zero("_spr") + _or_zero("_own_spr")).alias("spr"),
            (_or_zero("_n") + _or_zero("_own_n")).alias("n"),
            F.coalesce(F.col("_now").withField("before", F.coalesce(age, "_last.ts_ns")), "_last").alias("tick"),
        ).alias("_s"),
    )
    at = {k: F.max(F.when(F.col("_kind") == i, F.col("_s"))).alias(k) for i, k in enumerate(("_t", "_near", "_far"))}
    d = fills.join(found.groupBy(*key).agg(*at.values()), key, "left")

    bid, ask, bs, as_ = (F.col(f"_t.tick.{c}") for c in ("bid", "ask", "bid_size", "ask_size"))
    depth = bs + as_
    micro = ((bid * as_ + ask * bs) / depth - (bid + ask) / 2) / (ask - bid)
    known = F.col("_t.tick").isNotNull()
    within = lambda end, c: F.greatest(F.col(f"_t.{c}") - F.col(f"{end}.{c}"), F.lit(0.0))
    count = F.col("_t.n") - F.col("_near.n")
    d = d.withColumns(
        {
            "spread": ask - bid,
            "obi": F.when(known, F.when(depth > 0, (bs - as_) / depth).otherwise(0.0)),
            "micro_dev": F.when(known, F.when((depth > 0) & (ask > bid), micro).otherwise(0.0)),
            "rv_short": F.when(known, F.when(count > 0, F.sqrt(within("_near", "sq"))).otherwise(0.0)),
            "rv_long": F.when(known, F.when(F.col("_t.n") > F.col("_far.n"), F.sqrt(within("_far", "sq"))).otherwise(0.0)),
            "vol_short": F.when(known, within("_near", "vol")),
            "vol_long": F.when(known, within("_far", "vol")),
            "tick_rate": F.when(known, count / short_seconds),
            "spread_mean": F.when(count > 0, within("_near", "spr") / count),
            "dt_last_tick": (F.col("_t.tick.ts_ns") - F.col("_t.tick.before")) / 1e9,
            "sec_of_day": F.pmod(F.col("_t.tick.ts_ns"), F.lit(DAY_NS)) / 1e9,
        }
    )
    d = d.withColumns({"size_rel_vol": F.try_divide("size", "vol_short"), "spread_rel": F.when(F.col("spread_mean") > 0, F.col("spread") / F.col("spread_mean"))})
    return d.drop("_t", "_near", "_far")


_RUNNING = ("_sq", "_vol", "_spr", "_n")


def _square(mid: Column, before: Column) -> Column:
    """The squared log return; null without a mid before."""
    ret = F.log(mid / before)
    return ret * ret


def _or_zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def _before(rows: DataFrame, carried: DataFrame, by: Sequence[str]) -> DataFrame:
    """For each slice of ``rows``, what ``carried`` says at the end of the last slice before it; slices may lack ticks."""
    slices = rows.select(*by, _SLICE).distinct().withColumn("_mine", F.lit(True))
    values = F.struct(*_RUNNING, "_last")
    both = slices.unionByName(carried.select(*by, _SLICE, values.alias("_c")), allowMissingColumns=True)
    lower = Window.partitionBy(*by).orderBy(_SLICE).rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("_c", F.last("_c", ignorenulls=True).over(lower)).where("_mine").select(*by, _SLICE, "_c.*")


def counterparty_history(fills: DataFrame, delay_seconds: float = 0.0, rate: float = PRIOR_RATE, weight: float = PRIOR_WEIGHT, by: Sequence[str] = ()) -> DataFrame:
    """``fills`` (with label) with cp_fill_count and cp_toxic_rate_hist: earlier decided fills of the counterparty whose
    label was known, so at least ``delay_seconds`` before, and their toxic rate smoothed towards ``rate``."""
    decided, toxic = (F.col("label") >= 0).cast("long"), (F.col("label") == 1).cast("long")
    w = Window.partitionBy(*by, "counterparty_id")
    w = w.orderBy("ts_ns").rangeBetween(Window.unboundedPreceding, -seconds(delay_seconds)) if delay_seconds > 0 else w.orderBy("ts_ns", "seq").rowsBetween(Window.unboundedPreceding, -1)
    n, bad = F.coalesce(F.sum(decided).over(w), F.lit(0)), F.coalesce(F.sum(toxic).over(w), F.lit(0))
    return fills.withColumns({"cp_fill_count": n, "cp_toxic_rate_hist": (bad + rate * weight) / (n + weight)})


def counterparty_table(labelled: DataFrame) -> DataFrame:
    """counterparty_id, code (its place by name), toxic, total of decided fills."""
    d = labelled.groupBy("counterparty_id").agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") >= 0).alias("total"))
    return d.withColumn("code", F.dense_rank().over(Window.orderBy("counterparty_id")) - 1).where("total > 0").select("counterparty_id", "code", "toxic", "total")


def build_features(fills: DataFrame, ticks: DataFrame, readings: DataFrame | None = None, short_seconds: float = SHORT, long_seconds: float = LONG, delay_seconds: float = 0.0, by: Sequence[str] = (), slice_ns: int = SLICE_NS) -> DataFrame:
    """The core features, VPIN where readings are given, counterparty history where fills have labels, is_client_buy and
    session."""
    from . import vpin as V

    d = core_features(fills, ticks, short_seconds, long_seconds, by, slice_ns)
    if readings is not None:
        d = V.attach(d, readings, by, slice_ns)
    else:
        d = d.withColumns({c: F.lit(None).cast("double") for c in ("vpin", "vpin_pctile")})
    if "label" in d.columns:
        d = counterparty_history(d, delay_seconds, by=by)
    else:
        d = d.withColumns({"cp_toxic_rate_hist": F.lit(PRIOR_RATE), "cp_fill_count": F.lit(0)})
    hour = F.floor(F.col("sec_of_day") / 3600)
    return d.withColumns({"is_client_buy": (F.col("sign") > 0).cast("double"), "session": session_label(hour)})


def select_matrix(features: DataFrame, columns: Sequence[str] = ALL) -> DataFrame:
    """Decided rows in which none of the columns is missing."""
    return features.where("label >= 0").dropna(subset=list(columns))


def health(features: DataFrame, columns: Sequence[str] = CORE) -> DataFrame:
    """feature, nan_rate, std (sample), n_unique, from one pass."""
    row = features.agg(*[x.alias(f"{k}_{i}") for i, c in enumerate(columns) for k, x in (("nan", F.avg(F.when(F.col(c).isNull() | F.isnan(c), 1.0).otherwise(0.0))), ("std", F.stddev_samp(c)), ("unique", F.count_distinct(F.col(c))))])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"nan_{i}").alias("nan_rate"), F.col(f"std_{i}").alias("std"), F.col(f"unique_{i}").alias("n_unique")) for i, c in enumerate(columns)])))


def ffd_weights(d: float, least: float = 1e-4, most: int = 10_000) -> list[float]:
    """Weights of fractional differencing, the oldest first, down to the last of at least ``least``."""
    weights = [1.0]
    while len(weights) < most:
        w = -weights[-1] * (d - len(weights) + 1) / len(weights)
        if abs(w) < least:
            break
        weights.append(w)
    return weights[::-1]


def frac_diff(df: DataFrame, column: str, d: float, out: str | None = None, by: Sequence[str] = (), order: Sequence[str] = ("ts_ns", "seq"), least: float = 1e-4, slice_ns: int = SLICE_NS) -> DataFrame:
    """``df`` with the fractional difference of a column: null until the window is full and where it holds a null.

    Rows are numbered in time slices of the first column of ``order`` (whole nanoseconds) and cut into parts of so many
    rows; the last rows of a part, as many as a window may reach back, go to the next part too.
    """
    weights = ffd_weights(d, least)
    rows = max(ROWS, len(weights))
    df = prefix_sum(df, F.lit(1).cast("long"), "_row", by, slice_ns, order, order[0])
    lent = F.pmod(F.col("_row") - 1, F.lit(rows)) > rows - len(weights)
    df = df.withColumn("_later", F.explode(F.when(lent, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    df = df.withColumn("_part", F.floor((F.col("_row") - 1) / rows) + F.col("_later"))
    w = Window.partitionBy(*by, "_part").orderBy("_row").rowsBetween(-(len(weights) - 1), 0)
    held = F.collect_list(F.struct(F.col(column).alias("x"))).over(w)  # a struct keeps nulls in the list
    total = F.aggregate(F.zip_with(held, F.lit(weights), lambda h, c: h["x"] * c), F.lit(0.0), lambda a, b: a + b)
    return df.withColumn("_held", F.size(held)).withColumn(out or f"{column}_ffd", F.when(F.col("_held") == len(weights), total)).where("_later = 0").drop("_held", "_row", "_later", "_part")


