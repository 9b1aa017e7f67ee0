"""Exact quantiles of a column by refining ranges, with bounded state in every task and on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written

#: Bins that a range is cut into, and values of a range that are few enough to be sorted on the driver.
BINS, FEW = 1024, 1000


@dataclass(frozen=True)
class _Range:
    """Values from ``low`` to ``high``, both of which occur: ``count`` of them, ``below`` smaller ones outside."""

    low: float
    high: float
    below: int
    count: int

    @property
    def settled(self) -> bool:
        return self.low == self.high or self.count <= FEW


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """The linearly interpolated quantile of each share; None without values. Nulls and nan are left out.

    Each pass counts the values of a few ranges by bins and keeps the bins that hold a wanted rank, until every range
    holds one value alone or few values. Passes read one column, written once.
    """
    x = F.col(f"`{column}`").cast("double")
    values = written(df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x")), "values")
    n, low, high = values.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(shares)
    places = [(n - 1) * q for q in shares]
    wanted = {int(p) for p in places} | {min(int(p) + 1, n - 1) for p in places}
    ranges = {k: _Range(low, high, 0, n) for k in wanted}
    while open_ := sorted({r for r in ranges.values() if not r.settled}, key=lambda r: r.low):
        ranges.update(_refined(values, open_, ranges))
    few = sorted({r for r in ranges.values() if r.low < r.high}, key=lambda r: r.low)
    inside = F.lit(False)
    for r in few:
        inside = inside | F.col("x").between(r.low, r.high)
    found = sorted(row[0] for row in values.where(inside).collect()) if few else []
    at: dict[int, float] = {}
    for k, r in ranges.items():
        at[k] = r.low if r.low == r.high else [v for v in found if r.low <= v <= r.high][k - r.below]
    out = []
    for p in places:
        k = int(p)
        a, b = at[k], at[min(k + 1, n - 1)]
        out.append(a if a == b else a * (k + 1 - p) + b * (p - k))
    return out


def _refined(values: DataFrame, open_: list[_Range], ranges: dict[int, _Range]) -> dict[int, _Range]:
    """One pass: for each wanted rank in an open range, the bin of that range that holds it."""
    which = F.lit(None).cast("int")
    spot = F.lit(None).cast("double")
    for i, r in enumerate(open_):
        mine = F.col("x").between(r.low, r.high)
        which = F.when(mine, i).otherwise(which)
        # Halves keep the width of any range finite.
        spot = F.when(mine, (F.col("x") / 2 - r.low / 2) / (r.high / 2 - r.low / 2)).otherwise(spot)
    binned = values.select("x", which.alias("range"), F.least(F.floor(spot * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).where("range IS NOT NULL")
    counts = binned.groupBy("range", "bin").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    bins: dict[int, list] = {}
    for row in counts.orderBy("range", "bin").collect():  # at most BINS rows a range
        bins.setdefault(row["range"], []).append(row)
    out = {}
    for k, r in ranges.items():
        if r.settled:
            continue
        below = r.below
        for row in bins[open_.index(r)]:
            if k < below + row["n"]:
                out[k] = _Range(row["low"], row["high"], below, row["n"])
                break
            below += row["n"]
    return out
