"""Made-up ticks and fills, drawn in parallel by seed, and blotters of simple strategies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import indicators
from ..plans.series import SLICE_NS, prefix_sum, row_numbers

# Fixed values of the synthetic market.
START_NS, START_MID, BASE_SPREAD, SPREAD_NOISE, STEP_SD = 1_700_000_000_000_000_000, 1.1, 8e-5, 2e-5, 3e-5
BURST_LENGTH, BURST_SHARE, BURST_DRIFT, QUIET = 700, 0.25, 4e-6, 2.2
FILL = ("fill_id", "seq", "ts_ns", "sign", "price", "size", "counterparty_id")


def synthetic_ticks(spark: SparkSession, n: int = 200_000, seed: int = 42, informed: bool = True) -> DataFrame:
    """seq, ts_ns, bid, ask, mid, spread, volume, bid_size, ask_size, informed_regime.

    A random walk with bursts of drift (one in four stretches of ticks), wider and slower outside London hours. Times
    and prices are running sums, so the series is drawn and summed in parallel.
    """
    u = lambda k: F.rand(seed * 1000 + k)
    z = lambda k: F.randn(seed * 1000 + k)
    d = spark.range(n).select(F.col("id").alias("seq"), (F.floor(u(1) * 39_800_000) + 200_000).cast("long").alias("gap"), z(2).alias("z"), z(3).alias("zs"), u(4).alias("u1"), u(5).alias("u2"), u(6).alias("u3"))
    stretch = F.floor(F.col("seq") / BURST_LENGTH)
    of_stretch = F.pmod(F.xxhash64(F.lit(seed), stretch), F.lit(1000)) / 1000
    burst = (of_stretch < BURST_SHARE) & F.lit(informed)
    d = d.withColumns({"informed_regime": burst, "_drift": F.when(burst, F.when(of_stretch < BURST_SHARE / 2, BURST_DRIFT).otherwise(-BURST_DRIFT)).otherwise(0.0)})
    ordered = {"order": ("seq",), "slice_ns": 50_000}
    d = prefix_sum(d.withColumn("ts_ns", F.col("seq")), F.col("gap"), "_t", **ordered)
    hour = F.pmod(F.floor((F.col("_t") + START_NS) / 3_600_000_000_000), F.lit(24))
    d = d.withColumn("_wide", F.when((hour >= 7) & (hour < 17), 1.0).otherwise(QUIET))
    d = prefix_sum(d, F.col("z") * STEP_SD * F.sqrt("_wide") + F.col("_drift"), "_walk", **ordered)
    spread = (BASE_SPREAD + SPREAD_NOISE * F.abs("zs")) * F.col("_wide")
    mid = F.col("_walk") + START_MID
    size = lambda u: (0.5 + F.col(u)) * 1e6 / F.col("_wide")
    return d.select("seq", (F.col("_t") + START_NS).alias("ts_ns"), (mid - spread / 2).alias("bid"), (mid + spread / 2).alias("ask"), mid.alias("mid"), spread.alias("spread"), (1000.0 * (1 + F.floor(F.col("u3") * 49))).alias("volume"), size("u1").alias("bid_size"), size("u2").alias("ask_size"), "informed_regime")


def synthetic_fills(ticks: DataFrame, n: int = 5000, seed: int = 7, counterparties: int = 40, ahead: int = 300) -> DataFrame:
    """Fills at ticks: the first quarter of the counterparties trade in bursts, towards the mid ``ahead`` ticks later but
    for 15 in a hundred, and twice the size; adds is_informed."""
    rows = ticks.count()
    if rows < 10:
        raise ValueError("synthetic fills need at least 10 ticks")
    later = row_numbers(ticks, "_row")
    target = later.select((F.col("_row") - ahead).alias("_row"), F.col("mid").alias("_later"))
    d = later.join(target, "_row", "left").where(F.rand(seed) < min(1.0, 1.3 * n / rows))
    u = F.pmod(F.xxhash64(F.lit(seed), "seq"), F.lit(1_000_000)) / 1e6
    v = F.pmod(F.xxhash64(F.lit(seed + 1), "seq"), F.lit(1_000_000)) / 1e6
    wise = F.col("informed_regime") & (u < 0.5)
    toward = F.when(F.coalesce("_later", "mid") >= F.col("mid"), 1).otherwise(-1)
    sign = F.when(wise, F.when(v < 0.15, -toward).otherwise(toward)).otherwise(F.when(v < 0.5, 1).otherwise(-1))
    quarter = max(1, counterparties // 4)
    who = F.when(wise, F.floor(v * quarter)).otherwise(quarter + F.floor(v * (counterparties - quarter)))
    d = d.withColumns({"sign": sign.cast("int"), "is_informed": wise, "counterparty_id": F.format_string("CP_%03d", who.cast("int"))})
    d = d.withColumns({"price": F.when(F.col("sign") > 0, F.col("ask")).otherwise(F.col("bid")), "size": (1000.0 * (1 + F.floor(u * 19))) * F.when(F.col("is_informed"), 2).otherwise(1), "fill_id": F.col("seq")})
    return d.select(*FILL, "is_informed").orderBy(F.rand(seed + 2)).limit(n)


def trend_ticks(spark: SparkSession, n: int, seed: int = 5, drift: float = 4e-5) -> DataFrame:
    """A one-sided market (or with drift 0 a balanced one) of constant spread."""
    d = spark.range(n).select(F.col("id").alias("seq"), (F.col("id") * 10_000_000 + START_NS).alias("ts_ns"), (F.randn(seed) * STEP_SD + drift).alias("_step"), (1000.0 * (1 + F.floor(F.rand(seed + 1) * 19))).alias("volume"))
    d = prefix_sum(d, F.col("_step"), "_walk", slice_ns=50_000 * 10_000_000)
    mid = F.col("_walk") + START_MID
    return d.select("seq", "ts_ns", (mid - BASE_SPREAD / 2).alias("bid"), (mid + BASE_SPREAD / 2).alias("ask"), mid.alias("mid"), F.lit(BASE_SPREAD).alias("spread"), "volume")


def split_ticks(ticks: DataFrame, k: int) -> DataFrame:
    """Each tick as k of a kth of its volume, a nanosecond apart."""
    d = ticks.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return d.withColumns({"ts_ns": F.col("ts_ns") + F.col("_i"), "seq": F.col("seq") * k + F.col("_i"), "volume": F.col("volume") / k}).drop("_i")


def pickoffs(ticks: DataFrame, refresh_ticks: int = 200, half_spread: float = 2e-4, edge: float = 5e-5, by: Sequence[str] = (), slice_ns: int = SLICE_NS) -> DataFrame:
    """One row for each quote that is traded against: a quote stands ``half_spread`` around the mid of every
    ``refresh_ticks``-th tick until the next; the first tick whose mid is ``edge`` beyond it picks it off.

    block, seq, ts_ns, sign (of the client), price.
    """
    d = row_numbers(ticks, "_row", by, slice_ns).withColumn("block", F.floor((F.col("_row") - 1) / refresh_ticks).cast("long"))
    place = F.struct("ts_ns", "seq")
    quotes = d.groupBy(*by, "block").agg(F.min_by("mid", place).alias("quote"))
    d = d.join(quotes, [*by, "block"])
    up, down = F.col("mid") >= F.col("quote") + half_spread + edge, F.col("mid") <= F.col("quote") - half_spread - edge
    first = F.min(F.when(up | down, F.struct("ts_ns", "seq", F.when(up, 1).otherwise(-1).alias("sign"), F.when(up, F.col("quote") + half_spread).otherwise(F.col("quote") - half_spread).alias("price"))))
    return d.groupBy(*by, "block").agg(first.alias("x")).where("x is not null").select(*by, "block", "x.seq", "x.ts_ns", "x.sign", "x.price")


def lp_blotter(ticks: DataFrame, counterparties: int = 40, benign: int = 3, seed: int = 0, **options) -> DataFrame:
    """Pickoffs by fast counterparties, the lower numbers, and ``benign`` fills for each at random ticks by slow ones."""
    picked = pickoffs(ticks, **options).select("seq", "ts_ns", "sign", "price", F.lit(True).alias("fast"))
    n, rows = picked.count(), ticks.count()
    side = F.when(F.pmod(F.xxhash64(F.lit(seed), "seq"), F.lit(2)) == 0, 1).otherwise(-1)
    other = ticks.where(F.rand(seed) < min(1.0, benign * n / max(rows, 1))).select("seq", "ts_ns", side.alias("sign"), F.when(side > 0, F.col("ask")).otherwise(F.col("bid")).alias("price"), F.lit(False).alias("fast"))
    d = picked.unionByName(other).withColumn("_u", F.pmod(F.xxhash64(F.lit(seed + 1), "seq", "fast"), F.lit(1_000_000)) / 1e6)
    # Squares of a uniform number crowd at one end: the fast end for pickoffs, the slow one for the others.
    who = F.floor(F.when(F.col("fast"), F.col("_u") * F.col("_u")).otherwise(F.sqrt("_u")) * counterparties).cast("int")
    return d.select((F.col("seq") * 2 + F.col("fast").cast("long")).alias("fill_id"), "seq", "ts_ns", F.col("sign").cast("int").alias("sign"), "price", (1000.0 * (1 + F.floor(F.col("_u") * 19))).alias("size"), F.format_string("CP_%03d", who).alias("counterparty_id"))


def ma_blotter(ticks: DataFrame, fast: int = 200, slow: int = 800, by: Sequence[str] = ()) -> DataFrame:
    """A fill at each flip of a crossover of two exponential means, the signal taken from the tick before."""
    d = indicators.ema(row_numbers(ticks, "_row", by), {"_fast": ("mid", fast), "_slow": ("mid", slow)}, by, "_row")
    w = Window.partitionBy(*by).orderBy("_row")
    d = d.withColumn("sign", F.lag(F.when(F.col("_fast") > F.col("_slow"), 1).otherwise(-1)).over(w))
    d = d.where((F.col("_row") > slow)).withColumn("_before", F.lag("sign").over(w)).where("sign <> _before")
    return d.select(F.col("seq").alias("fill_id"), "seq", "ts_ns", "sign", F.when(F.col("sign") > 0, F.col("ask")).otherwise(F.col("bid")).alias("price"), F.lit(1000.0).alias("size"), F.lit("CP_000").alias("counterparty_id"))


def random_blotter(ticks: DataFrame, n: int = 1000, seed: int = 0, counterparties: int = 40) -> DataFrame:
    """Fills at n ticks drawn without replacement."""
    h = lambda k: F.pmod(F.xxhash64(F.lit(seed + k), "seq"), F.lit(1_000_000))
    d = ticks.orderBy(F.xxhash64(F.lit(seed), "seq"), "seq").limit(n).withColumn("sign", F.when(h(1) % 2 == 0, 1).otherwise(-1))
    return d.select(F.col("seq").alias("fill_id"), "seq", "ts_ns", "sign", F.when(F.col("sign") > 0, F.col("ask")).otherwise(F.col("bid")).alias("price"), (1000.0 * (1 + h(2) % 19)).alias("size"), F.format_string("CP_%03d", (h(3) % counterparties).cast("int")).alias("counterparty_id"))
