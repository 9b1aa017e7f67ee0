"""Ordered computations over long series, in time slices instead of one window over everything.

A series is ordered by (ts_ns, seq) within the columns ``by`` (such as an instrument; none by default). Windows run
within a slice of ``slice_ns``; what earlier slices contribute (totals, last rows) comes from a table of one row a
slice. So one long series spreads over as many tasks as it has slices.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .scratch import written

DAY_NS = 86_400_000_000_000
SLICE_NS = DAY_NS
_SLICE = "_slice"


def seconds(x: float) -> int:
    """Seconds as whole nanoseconds, rounded."""
    return round(x * 1e9)


def sliced(df: DataFrame, slice_ns: int = SLICE_NS, ts: str = "ts_ns") -> DataFrame:
    return df.withColumn(_SLICE, F.floor(F.col(ts) / F.lit(slice_ns)).cast("long"))


def inside(by: Sequence[str] = (), order: Sequence[str] = ("ts_ns", "seq")) -> WindowSpec:
    """The window of a slice, in order."""
    return Window.partitionBy(*by, _SLICE).orderBy(*order)


def _over_slices(by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(_SLICE)


def _attach(df: DataFrame, per_slice: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.join(per_slice, [*by, _SLICE], "left")


def prefix_sum(df: DataFrame, value: Column, out: str, by: Sequence[str] = (), slice_ns: int = SLICE_NS, order: Sequence[str] = ("ts_ns", "seq"), ts: str = "ts_ns") -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` up to each row, itself included."""
    d = sliced(df.withColumn("_v", value), slice_ns, ts)
    totals = d.groupBy(*by, _SLICE).agg(F.sum("_v").alias("_t"))
    before = totals.withColumn("_b", F.sum("_t").over(_over_slices(by).rowsBetween(Window.unboundedPreceding, -1))).drop("_t")
    summed = _attach(d, before, by).withColumn(out, F.coalesce("_b", F.lit(0)) + F.sum("_v").over(inside(by, order).rowsBetween(Window.unboundedPreceding, 0)))
    return summed.drop("_v", "_b", _SLICE)


def previous(df: DataFrame, columns: dict[str, str], by: Sequence[str] = (), slice_ns: int = SLICE_NS, order: Sequence[str] = ("ts_ns", "seq")) -> DataFrame:
    """``df`` with, for each name in ``columns``, its column's value one row earlier (null in the first row)."""
    d = sliced(df, slice_ns)
    last = d.groupBy(*by, _SLICE).agg(F.max_by(F.struct(*columns.values()), F.struct(*order)).alias("_l"))
    before = last.withColumn("_b", F.lag("_l").over(_over_slices(by))).drop("_l")
    d = _attach(d, before, by)
    first = F.row_number().over(inside(by, order)) == 1
    for name, column in columns.items():
        d = d.withColumn(name, F.when(first, F.col(f"_b.{column}")).otherwise(F.lag(column).over(inside(by, order))))
    return d.drop("_b", _SLICE)


def row_numbers(df: DataFrame, out: str = "row", by: Sequence[str] = (), slice_ns: int = SLICE_NS) -> DataFrame:
    """``df`` with ``out``: 1, 2, ... in order."""
    return prefix_sum(df, F.lit(1).cast("long"), out, by, slice_ns)


def asof(left: DataFrame, right: DataFrame, columns: Sequence[str], by: Sequence[str] = (), slice_ns: int = SLICE_NS, at: str = "ts_ns") -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` whose ts_ns is at or before the left row's ``at``.

    Of right rows at the same time the last by seq counts. Left rows without such a row keep nulls.
    """
    names = [c for c in left.columns if c not in columns]
    l_rows = left.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_seq"), F.struct(*[F.col(c) for c in names]).alias("_l"))
    r_rows = right.select(*by, F.col("ts_ns").alias("_at"), F.lit(0).alias("_kind"), F.col("seq").cast("long").alias("_seq"), F.struct(*columns).alias("_r"))
    both = sliced(l_rows.unionByName(r_rows, allowMissingColumns=True), slice_ns, "_at")
    last = both.groupBy(*by, _SLICE).agg(F.max_by("_r", F.when(F.col("_kind") == 0, F.struct("_at", "_seq"))).alias("_last"))
    before = last.withColumn("_b", F.last("_last", ignorenulls=True).over(_over_slices(by).rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    w = inside(by, ["_at", "_kind", "_seq"]).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_r", ignorenulls=True).over(w)).where("_kind = 1")
    found = _attach(found, before, by).withColumn("_found", F.coalesce("_found", "_b"))
    return found.select(*[F.col("_l")[c].alias(c) for c in names], *[F.col("_found")[c].alias(c) for c in columns])


def trailing(left: DataFrame, right: DataFrame, aggregates: dict[str, Column], width_ns: int, by: Sequence[str] = (), at: str = "ts_ns", key: str = "fill_id") -> DataFrame:
    """``key`` with aggregates over the right rows of [at - width_ns, at], both ends included.

    Slices are ``width_ns`` long, so a window lies in its own slice and the one before; right rows go to both slices
    that may need them. Columns that the aggregates name belong to ``right``.
    """
    l_rows = left.select(*by, F.col(key), F.col(at).alias("_at"), F.lit(True).alias("_mine"))
    l_rows = sliced(l_rows, width_ns, "_at")
    r_rows = sliced(right.withColumn("_at", F.col("ts_ns")), width_ns, "_at")
    r_rows = r_rows.withColumn(_SLICE, F.explode(F.array(F.col(_SLICE), F.col(_SLICE) + 1))).withColumn("_mine", F.lit(False))
    both = l_rows.unionByName(r_rows, allowMissingColumns=True)
    w = Window.partitionBy(*by, _SLICE).orderBy("_at").rangeBetween(-width_ns, 0)
    for name, agg in aggregates.items():
        both = both.withColumn(name, agg.over(w))
    return both.where("_mine").select(key, *aggregates)


def numbered(df: DataFrame, order: str, out: str = "_i", by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``out``: 1, 2, ... in the order of a column of any kind, from ranges of it and a table of one row a range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, *by, order).withColumn(_SLICE, F.spark_partition_id().cast("long")), "ranges")
    counts = ranged.groupBy(*by, _SLICE).agg(F.count("*").alias("_t"))
    before = counts.withColumn("_b", F.sum("_t").over(_over_slices(by).rowsBetween(Window.unboundedPreceding, -1))).drop("_t")
    placed = _attach(ranged, before, by).withColumn(out, F.coalesce("_b", F.lit(0)) + F.row_number().over(inside(by, [order])))
    return placed.drop("_b", _SLICE)


#: Rows of a slice of decayed sums, at most, and the smallest factor within one.
DECAY_ROWS, DECAY_LEAST = 4096, 1e-100


def decayed_sums(df: DataFrame, values: dict[str, Column], keep: float, by: Sequence[str] = (), at: str = "_i") -> DataFrame:
    """``df`` with, for each name, the sum of its value over this and all earlier rows, times keep^(rows between).

    Rows are numbered by ``at`` from 1. A slice's sums are running sums of values that are scaled up by their place, then
    scaled down; slices are short enough for that. What earlier slices carry over is the same kind of sum over the slices'
    last sums, so slices are scanned by this function too, until the factor of a slice is nothing: then the last few
    slices are all that is left to carry.
    """
    keep = max(keep, 1e-30)
    rows = max(1, min(DECAY_ROWS, int(math.log(DECAY_LEAST) / math.log(keep)))) if keep < 1 else DECAY_ROWS
    place = F.pmod(F.col(at) - 1, F.lit(rows)) + 1
    d = df.withColumns({_SLICE: F.floor((F.col(at) - 1) / rows).cast("long"), "_p": place})
    d = d.withColumns({f"_v{k}": F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in enumerate(values.values())})
    names = [f"_v{k}" for k in range(len(values))]
    ends = d.groupBy(*by, _SLICE).agg(*[F.sum(F.col(v) * F.pow(F.lit(keep), rows - F.col("_p"))).alias(v) for v in names])
    factor = keep**rows
    earlier = _over_slices(by)
    if factor <= 10 * DECAY_LEAST:
        # Two slices back is 1e-100 of this already; missing slices between would only make it less.
        known = F.max_by(F.struct(_SLICE, *names), F.when(F.greatest(*[F.abs(v) for v in names]) > 0, F.col(_SLICE)))
        last = ends.withColumn("_l", known.over(earlier.rowsBetween(Window.unboundedPreceding, -1)))
        fade = F.pow(F.lit(factor), F.col(_SLICE) - F.col(f"_l.{_SLICE}") - 1)
        carried = last.select(*by, _SLICE, *[(F.col(f"_l.{v}") * fade).alias(f"_c{v}") for v in names])
    else:
        ends = written(ends, "slices")
        if not ends.where(F.col(_SLICE) > 0).take(1):
            carried = ends.select(*by, _SLICE, *[F.lit(0.0).alias(f"_c{v}") for v in names])
        else:
            # The sums up to slice s, which is row s + 1 of this table, go to slice s + 1.
            slices = ends.withColumn("_k", F.col(_SLICE) + 1)
            scanned = decayed_sums(slices, {f"_t{v}": F.col(v) for v in names}, factor, by, "_k")
            carried = scanned.select(*by, F.col("_k").alias(_SLICE), *[F.col(f"_t{v}").alias(f"_c{v}") for v in names])
    d = _attach(d, carried, by)
    w = inside(by, [at]).rowsBetween(Window.unboundedPreceding, 0)
    down = F.pow(F.lit(keep), F.col("_p"))
    sums = {
        out: (F.sum(F.col(v) * F.pow(F.lit(keep), -F.col("_p"))).over(w) + F.coalesce(F.col(f"_c{v}"), F.lit(0.0))) * down
        for out, v in zip(values, names)
    }
    return d.withColumns(sums).drop(_SLICE, "_p", *names, *[f"_c{v}" for v in names])


def lent_to_next(df: DataFrame, at: str, rows: int, back: int) -> DataFrame:
    """``df`` cut into slices of so many rows by ``at``, numbered from 1; the last ``back`` of a slice are in the next one too,
    with ``_lent`` true."""
    inside_slice = F.pmod(F.col(at) - 1, F.lit(rows))
    d = df.withColumn("_lent", F.explode(F.when(inside_slice >= rows - back, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    return d.withColumn(_SLICE, F.floor((F.col(at) - 1) / rows).cast("long") + F.col("_lent").cast("long"))
