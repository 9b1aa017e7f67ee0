"""Unit-root tests and the choice of a fractional order, from Gram matrices that Spark adds up.

The augmented Dickey-Fuller regression of a series on its level, its own lagged changes and a constant needs only the
sums of products of these columns. A series is cut into parts of so many rows, the last rows of a part go to the next one
too, and each task adds the products of its parts, for all candidate orders of fractional differencing at once. So one
pass over the rows gives every regression of every lag and order; what reaches the driver is at most MERGERS sums a
series, whose size grows with the fourth root of the rows (70 lags for 10**5 rows, 680 for 10**9).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from ..plans.series import SLICE_NS, prefix_sum
from .features import ffd_weights, frac_diff

#: Rows of a part, at least, and sums of a series that reach the driver.
PART_ROWS = 16_384
MERGERS = 8
#: Fewer values than these are not tested.
LEAST, LEAST_DIFFERENCED, LEAST_HEALTH = 20, 30, 30
SIGNIFICANT = 0.05

# The response surface of the test with a constant (MacKinnon 1994, one variable).
TAU_LOWEST, TAU_SWITCH, TAU_HIGHEST = -18.83, -1.61, 2.74
TAU_BELOW = (2.1659, 1.4412, 0.038269)
TAU_ABOVE = (1.7339, 0.93202, -0.12745, -0.010368)


def p_value(statistic: float) -> float:
    """The p-value of a Dickey-Fuller statistic with a constant."""
    if math.isnan(statistic):
        return math.nan
    if statistic > TAU_HIGHEST:
        return 1.0
    if statistic < TAU_LOWEST:
        return 0.0
    surface = TAU_BELOW if statistic <= TAU_SWITCH else TAU_ABOVE
    z = sum(c * statistic**k for k, c in enumerate(surface))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def most_lags(n: int, max_lag: int | None = None) -> int:
    """The largest lag that is tried for n values (Schwert's rule, and no more than the values allow)."""
    return min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25) if max_lag is None else max_lag)


@dataclass
class Sums:
    """What the regressions of one series need.

    ``gram`` holds the sums of products of (1, level before, changes 1..lags rows back, change); levels are less
    ``centre``. ``head`` holds the first values, for regressions that need fewer of them before their first row. ``moments``
    are count and sums of x, y, xx, yy, xy of the values y and the undifferenced values x, both less their centres.
    ``kinds`` are up to three different values.
    """

    lags: int
    gram: np.ndarray
    moments: np.ndarray = field(default_factory=lambda: np.zeros(6))
    head: list[float] = field(default_factory=list)
    kinds: list[float] = field(default_factory=list)

    @classmethod
    def zero(cls, lags: int) -> Sums:
        size = max(lags, 0) + 3
        return cls(lags, np.zeros((size, size)))

    def merge(self, other: Sums) -> None:
        self.gram += other.gram
        self.moments += other.moments
        self.head = self.head or other.head
        self.kinds = sorted({*self.kinds, *other.kinds})[:3]

    def row(self) -> dict:
        return {"gram": self.gram.ravel().tolist(), "moments": self.moments.tolist(), "head": self.head, "kinds": self.kinds}

    @classmethod
    def of(cls, lags: int, row) -> Sums:
        size = max(lags, 0) + 3
        return cls(lags, np.array(row["gram"]).reshape(size, size), np.array(row["moments"]), list(row["head"]), list(row["kinds"]))


def products(y: np.ndarray, lags: int, centre: float, skip: int = 0) -> np.ndarray:
    """Sums of products over the regression's rows of ``y``; the first ``skip`` values only stand before others."""
    changes = np.diff(y)
    size = lags + 3
    first = max(lags, skip - 1)  # place of the first row's change
    if len(changes) <= first:
        return np.zeros((size, size))
    back = np.lib.stride_tricks.sliding_window_view(changes, lags + 1)[first - lags :]
    z = np.empty((len(back), size))
    z[:, 0] = 1.0
    z[:, 1] = y[first:-1] - centre
    z[:, 2:] = back[:, ::-1][:, [*range(1, lags + 1), 0]]
    return z.T @ z


@dataclass
class Test:
    """n values, the chosen lag, the statistic of the level's coefficient and its p-value; nan where not tested."""

    n: int
    lag: int = 0
    statistic: float = math.nan
    p: float = math.nan

    @property
    def stationary(self) -> bool:
        return self.p < SIGNIFICANT


def _ssr(gram: np.ndarray) -> tuple[np.ndarray, float]:
    """Reductions of the squared change by the columns of ``gram`` one after the other (by Cholesky steps), and its square."""
    scale = np.sqrt(np.maximum(np.diagonal(gram), 0.0))
    scale[scale == 0.0] = 1.0
    a = gram / np.outer(scale, scale)
    k = len(a) - 1
    gains = np.zeros(k)
    for i in range(k):
        # A column that those before it explain adds nothing, as with a pseudo-inverse.
        if a[i, i] <= 1e-13:
            continue
        gains[i] = a[i, k] ** 2 / a[i, i]
        a[i + 1 :, i + 1 :] -= np.outer(a[i + 1 :, i], a[i, i + 1 :]) / a[i, i]
    return gains * scale[k] ** 2, float(gram[k, k])


def solve(sums: Sums, n: int, centre: float) -> Test:
    """The test on ``n`` values: the lag of the least information criterion over equal rows, then that lag over all rows."""
    if n < LEAST or len(sums.kinds) < 3 or sums.lags < 0:
        return Test(n)
    rows = sums.gram[0, 0]
    gains, total = _ssr(sums.gram)
    left = np.maximum(total - np.cumsum(gains), 0.0)[1:]
    with np.errstate(divide="ignore"):
        criterion = rows * np.log(left / rows) + 2 * np.arange(2, sums.lags + 3)
    lag = int(np.argmin(criterion))
    keep = [*range(lag + 2), sums.lags + 2]
    gram = sums.gram[np.ix_(keep, keep)]
    if lag < sums.lags:
        # The rows that only the longer lags had to leave out are the first ones.
        gram = gram + products(np.array(sums.head), lag, centre)
    k, rows = lag + 2, gram[0, 0]
    scale = np.sqrt(np.maximum(np.diagonal(gram)[:k], 0.0))
    scale[scale == 0.0] = 1.0
    inverse = np.linalg.pinv(gram[:k, :k] / np.outer(scale, scale), hermitian=True)
    beta = inverse @ (gram[:k, k] / scale)
    residual = gram[k, k] - beta @ (gram[:k, k] / scale)
    freedom = rows - k
    if freedom <= 0 or residual <= 0 or inverse[1, 1] <= 0:
        return Test(n, lag)
    statistic = float(beta[1] / math.sqrt(residual / freedom * inverse[1, 1]))
    return Test(n, lag, statistic, p_value(statistic))


_GRAM = "series string, item int, gram array<double>, moments array<double>, head array<double>, kinds array<double>"
_ARROW = pa.schema(
    [("series", pa.string()), ("item", pa.int32()), *[(c, pa.list_(pa.float64())) for c in ("gram", "moments", "head", "kinds")]]
)


@dataclass
class _Plan:
    """What is computed for a series: its mean, and weights, lags and centre of each order."""

    mean: float
    weights: list[list[float]]
    lags: list[int]

    def centres(self) -> list[float]:
        return [self.mean * sum(w) for w in self.weights]

    def before(self) -> int:
        """Rows that a part needs from the one before it."""
        return max(len(w) + max(l, 0) for w, l in zip(self.weights, self.lags))


def _part_sums(x: np.ndarray, lent: int, first: bool, plan: _Plan) -> list[Sums]:
    """Sums of one part for all orders; the first ``lent`` rows belong to the part before."""
    out = []
    for weights, lags, centre in zip(plan.weights, plan.lags, plan.centres()):
        sums = Sums.zero(lags)
        out.append(sums)
        if len(x) < len(weights):
            continue
        y = x if len(weights) == 1 else np.convolve(x, weights[::-1], "valid")
        skip = max(0, lent - len(weights) + 1)  # values of rows that are not the part's own
        own, level = y[skip:], x[max(lent, len(weights) - 1) :] - plan.mean
        shifted = own - centre
        sums.moments = np.array([len(own), level.sum(), shifted.sum(), level @ level, shifted @ shifted, level @ shifted])
        sums.kinds = np.unique(own)[:3].tolist()
        if lags >= 0:
            sums.gram = products(y, lags, centre, skip)
            if first:
                sums.head = y[: lags + 1].tolist()
    return out


def _sums(rows: DataFrame, plans: dict[str, _Plan]) -> dict[str, list[Sums]]:
    """For each series of ``rows`` (series, row from 1 without gaps, x), the sums of each of its plan's orders."""
    spark = rows.sparkSession
    ship(spark)
    known = {name: p for name, p in plans.items() if p.weights}
    if not known:
        return {name: [] for name in plans}
    lent = max(p.before() for p in known.values())
    size = max(PART_ROWS, 2 * lent)
    inside = F.pmod(F.col("row") - 1, F.lit(size))
    part = F.floor((F.col("row") - 1) / size).cast("long")
    cut = rows.where(F.col("series").isin(list(known))).select("series", "row", F.col("x").cast("double").alias("x"), F.explode(F.when(inside >= size - lent, F.array(part, part + 1)).otherwise(F.array(part))).alias("part"))

    def flush(batch_rows: list[np.ndarray], series: str, number: int, held: dict) -> None:
        at, x = np.concatenate([b[0] for b in batch_rows]), np.concatenate([b[1] for b in batch_rows])
        borrowed = int(np.searchsorted(at, number * size + 1))
        if borrowed == len(x):
            return  # nothing but rows that the part before lent
        found = _part_sums(x, borrowed, number == 0, known[series])
        if series in held:
            for a, b in zip(held[series], found):
                a.merge(b)
        else:
            held[series] = found

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[Sums]] = {}
        key, waiting = None, []
        for batch in batches:
            names, numbers = batch.column(0).to_pylist(), batch.column(3).to_numpy()
            at, x = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            starts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1] or numbers[i] != numbers[i - 1]), len(names)]
            for a, b in zip(starts, starts[1:]):
                if a == b:
                    continue
                if key is not None and key != (names[a], numbers[a]):
                    flush(waiting, *key, held)
                    waiting = []
                key = (names[a], int(numbers[a]))
                waiting.append((at[a:b], x[a:b]))
        if waiting:
            flush(waiting, *key, held)
        yield from as_rows({s: dict(enumerate(items)) for s, items in held.items()})

    def as_rows(held: dict[str, dict[int, Sums]]) -> Iterator[pa.RecordBatch]:
        made = [{"series": s, "item": i, **sums.row()} for s, items in held.items() for i, sums in items.items()]
        if made:
            yield pa.RecordBatch.from_pylist(made, _ARROW)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, Sums]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                sums = Sums.of(known[row["series"]].lags[row["item"]], row)
                items = held.setdefault(row["series"], {})
                if row["item"] in items:
                    items[row["item"]].merge(sums)
                else:
                    items[row["item"]] = sums
        yield from as_rows(held)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partial = cut.repartition(n, "series", "part").sortWithinPartitions("series", "part", "row").mapInArrow(gather, _GRAM)
    out: dict[str, list[Sums]] = {name: [Sums.zero(l) for l in p.lags] for name, p in plans.items()}
    for row in partial.repartition(min(n, MERGERS)).mapInArrow(join, _GRAM).toLocalIterator():
        out[row["series"]][row["item"]].merge(Sums.of(known[row["series"]].lags[row["item"]], row))
    return out


def _long(df: DataFrame, columns: Sequence[str], order: Sequence[str], slice_ns: int) -> DataFrame:
    """series, row, x: the columns below each other, their values that are there numbered in order."""
    pairs = F.array(*[F.struct(F.lit(c).alias("series"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns])
    rows = df.select(*order, F.inline(pairs)).where(F.col("x").isNotNull() & ~F.isnan("x"))
    return prefix_sum(rows, F.lit(1).cast("long"), "row", ["series"], slice_ns, order, order[0]).select("series", "row", "x")


def _totals(rows: DataFrame) -> dict[str, tuple[int, float]]:
    return {r["series"]: (r["n"], r["mean"]) for r in rows.groupBy("series").agg(F.count("x").alias("n"), F.avg("x").alias("mean")).collect()}


def stationarity(
    df: DataFrame, columns: Sequence[str], order: Sequence[str] = ("ts_ns", "seq"), max_lag: int | None = None, slice_ns: int = SLICE_NS
) -> dict[str, Test]:
    """The augmented Dickey-Fuller test of each column, in the order of ``order`` (whole nanoseconds first).

    Nulls and nan are left out, the rows around them follow each other. The lag is the one of least information
    criterion. A column of fewer than LEAST values, or of fewer than three different ones, is not tested: nan. Rows must differ in
    ``order``. An empty table gives tests of n = 0.
    """
    rows = _long(df, columns, order, slice_ns)
    totals = _totals(rows)
    plans = {c: _Plan(totals[c][1], [[1.0]], [most_lags(totals[c][0], max_lag)]) for c in columns if c in totals}
    found = _sums(rows, plans)
    return {c: solve(found[c][0], totals[c][0], totals[c][1]) if c in plans else Test(0) for c in columns}


def stationarity_report(df: DataFrame, columns: Sequence[str], order: Sequence[str] = ("ts_ns", "seq"), max_lag: int | None = None, slice_ns: int = SLICE_NS) -> DataFrame:
    """series, n, lag, adf_stat, adf_pvalue, is_stationary_5pct, a row for each column; null where not tested."""
    tests = stationarity(df, columns, order, max_lag, slice_ns)
    rows = [(c, t.n, *_nulls(t)) for c, t in tests.items()]
    return df.sparkSession.createDataFrame(rows, "series string, n long, lag int, adf_stat double, adf_pvalue double, is_stationary_5pct boolean")


def _nulls(t: Test) -> tuple:
    tested = not math.isnan(t.statistic)
    return (t.lag if tested else None, t.statistic if tested else None, t.p if tested else None, t.stationary)


@dataclass
class Order:
    """One candidate order of differencing: its test and the correlation of the differenced with the given values."""

    d: float
    test: Test
    corr: float


def ffd_orders(
    df: DataFrame, column: str, candidates: Sequence[float], least: float = 1e-4, order: Sequence[str] = ("ts_ns", "seq"), slice_ns: int = SLICE_NS
) -> list[Order]:
    """Every candidate order of fractional differencing of a column, tested.

    A differenced value is there where the whole window of weights is. A column without gaps between its first and last
    value takes one pass for all orders. One with gaps is differenced order by order first, since each order leaves out
    other rows, and then all orders are again tested in one pass.
    """
    weights = [[1.0] if d == 0 else ffd_weights(d, least) for d in candidates]
    value = F.col(f"`{column}`").cast("double")
    given = df.select(*order, F.when(~F.isnan(value), value).alias("x"))
    numbered = prefix_sum(given, F.lit(1).cast("long"), "at", (), slice_ns, order, order[0])
    span = numbered.where("x IS NOT NULL").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"), F.avg("x").alias("mean")).first()
    n, mean = span["n"], span["mean"]
    if not n:
        return [Order(float(d), Test(0), math.nan) for d in candidates]
    if span["last"] - span["first"] + 1 == n:
        rows = numbered.where("x IS NOT NULL").select(F.lit("x").alias("series"), (F.col("at") - (span["first"] - 1)).alias("row"), "x")
        sizes = [max(0, n - len(w) + 1) for w in weights]
        plan = _Plan(mean, weights, [most_lags(m) if m >= LEAST else -1 for m in sizes])
        found = _sums(rows, {"x": plan})["x"]
        return [Order(float(d), solve(s, m, c), _correlation(s.moments)) for d, s, m, c in zip(candidates, found, sizes, plan.centres())]
    names = [f"y{i}" for i in range(len(weights))]
    wide = given
    for name, d in zip(names, candidates):
        wide = wide.withColumn(name, F.col("x")) if d == 0 else frac_diff(wide, "x", d, name, (), order, least, slice_ns)
    corr = wide.agg(*[F.corr(F.when(F.col(c).isNotNull(), F.col("x")), c).alias(c) for c in names], *[F.count(c).alias(f"n_{c}") for c in names]).first()
    tests = stationarity(wide, names, order, None, slice_ns)
    return [Order(float(d), tests[c], corr[c] if corr[c] is not None and corr[f"n_{c}"] > 2 else math.nan) for d, c in zip(candidates, names)]


def _correlation(moments: np.ndarray) -> float:
    n, x, y, xx, yy, xy = moments
    if n <= 2:
        return math.nan
    spread = (xx - x * x / n) * (yy - y * y / n)
    return float((xy - x * y / n) / math.sqrt(spread)) if spread > 0 else math.nan


def steps(step: float) -> list[float]:
    """0, step, ... up to 1."""
    return [round(i * step, 10) for i in range(round(1 / step) + 1)]


def min_ffd_order(df: DataFrame, column: str, candidates: Sequence[float] | None = None, least: float = 1e-4, order: Sequence[str] = ("ts_ns", "seq"), slice_ns: int = SLICE_NS) -> DataFrame:
    """d, adf_stat, adf_pvalue, stationary, corr_with_level, n_obs for each candidate (0, 0.05, ... 1 by default)."""
    found = ffd_orders(df, column, steps(0.05) if candidates is None else candidates, least, order, slice_ns)
    rows = [(o.d, *_nulls(o.test)[1:], None if math.isnan(o.corr) else o.corr, o.test.n) for o in found]
    return df.sparkSession.createDataFrame(rows, "d double, adf_stat double, adf_pvalue double, stationary boolean, corr_with_level double, n_obs long")


def find_min_d(df: DataFrame, column: str, candidates: Sequence[float] | None = None, least: float = 1e-4, significant: float = SIGNIFICANT, order: Sequence[str] = ("ts_ns", "seq"), slice_ns: int = SLICE_NS) -> float:
    """The first candidate (0, 0.1, ... 1 by default) that makes at least LEAST_DIFFERENCED stationary values; else 1."""
    for o in ffd_orders(df, column, steps(0.1) if candidates is None else candidates, least, order, slice_ns):
        if o.test.n >= LEAST_DIFFERENCED and o.test.p < significant:
            return o.d
    return 1.0


def add_fractional_differencing(
    features: DataFrame,
    columns: Sequence[str] = ("vpin", "spread_mean"),
    d: float | None = None,
    least: float = 1e-4,
    suffix: str = "_ffd",
    order: Sequence[str] = ("ts_ns", "seq"),
    slice_ns: int = SLICE_NS,
) -> tuple[DataFrame, dict[str, float]]:
    """``features`` with each column's fractional difference under its name and ``suffix``, and the orders taken.

    Without ``d`` each column's order is the one of find_min_d. Columns that are not there are passed over.
    """
    orders: dict[str, float] = {}
    for c in columns:
        if c not in features.columns:
            continue
        orders[c] = float(d) if d is not None else find_min_d(features, c, None, least, order=order, slice_ns=slice_ns)
        if orders[c] == 0:
            features = features.withColumn(c + suffix, F.col(f"`{c}`").cast("double"))
        else:
            features = frac_diff(features, c, orders[c], c + suffix, (), order, least, slice_ns)
    return features, orders


def health(features: DataFrame, columns: Sequence[str], order: Sequence[str] = ("ts_ns", "seq"), slice_ns: int = SLICE_NS) -> DataFrame:
    """feature, nan_rate, std, n_unique, adf_pvalue: features.health() with the unit-root test of every column.

    Columns with fewer than LEAST_HEALTH values or fewer than three different ones have no p-value.
    """
    from . import features as plain

    tests = stationarity(features, columns, order, None, slice_ns)
    rows = [(c, t.p if t.n >= LEAST_HEALTH and not math.isnan(t.p) else None) for c, t in tests.items()]
    table = features.sparkSession.createDataFrame(rows, "feature string, adf_pvalue double")
    return plain.health(features, columns).join(F.broadcast(table), "feature")
