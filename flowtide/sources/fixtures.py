"""Ticks, fills and daily bars made from the driver's tables, for queries and tests.

Prices are whole points until the last division and volumes are whole numbers, so other engines get the same bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.series import prefix_sum

#: Volume of a bucket, whatever the tables' size: 1,000 ticks make about 250 buckets, and their number grows with the ticks.
BUCKET_VOLUME = 20_000.0


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a walk of whole points, which ticks and fills are made of."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"),
        "user_id",
        "event_type",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    step = F.pmod(F.col("seq") * 7919 + F.col("cents"), F.lit(201)) - 100
    return prefix_sum(e, step, "walk").withColumn("mid_pts", F.col("walk") + 1_100_000).withColumn("half_pts", 40 + F.pmod("cents", F.lit(20)))


def ticks(p: DataFrame) -> DataFrame:
    """seq, ts_ns, bid, ask, mid, spread, volume, bid_size, ask_size, mid_pts."""
    return p.select(
        "seq",
        "ts_ns",
        ((F.col("mid_pts") - F.col("half_pts")) / 1e6).alias("bid"),
        ((F.col("mid_pts") + F.col("half_pts")) / 1e6).alias("ask"),
        (F.col("mid_pts") / 1e6).alias("mid"),
        (2 * F.col("half_pts") / 1e6).alias("spread"),
        F.col("cents").cast("double").alias("volume"),
        (1e6 * (1 + F.pmod("k", F.lit(50)))).alias("bid_size"),
        (1e6 * (1 + F.pmod(F.col("k") * 7, F.lit(50)))).alias("ask_size"),
        "mid_pts",
    )


def fills(p: DataFrame) -> DataFrame:
    """fill_id, seq, ts_ns, sign, price, size, counterparty_id."""
    p = p.where(F.col("event_type").isin("purchase", "error"))
    sign = F.when(F.col("seq") % 2 == 0, 1).otherwise(-1)
    return p.select(
        F.col("seq").alias("fill_id"),
        "seq",
        "ts_ns",
        sign.alias("sign"),
        ((F.col("mid_pts") + sign * F.col("half_pts")) / 1e6).alias("price"),
        ((1 + F.pmod("cents", F.lit(20))) * 1000).cast("double").alias("size"),
        F.concat(F.lit("CP_"), F.lpad(F.pmod("user_id", F.lit(40)).cast("string"), 3, "0")).alias("counterparty_id"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, close, revenue of each shipping day of lineitem."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    revenue = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long")
    days = li.groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.sum(cents).alias("cents"), F.count("*").alias("n"), F.sum(revenue).alias("revenue_cents"))
    return days.select("day", (F.round(F.col("cents") / F.col("n")).cast("long") / 100).alias("close"), F.col("revenue_cents").cast("double").alias("revenue"))


#: The same as common table expressions in SQL.
TICKS_SQL = """
pts AS (
  SELECT event_id AS seq, epoch_us(ts) * 1000 AS ts_ns, user_id, event_type, cast(round(value * 100) AS BIGINT) AS cents,
         cast(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events
), walked AS (
  SELECT *, 1100000 + cast(sum((seq * 7919 + cents) % 201 - 100) OVER (ORDER BY ts_ns, seq) AS BIGINT) AS mid_pts, 40 + cents % 20 AS half_pts FROM pts
), ticks AS (
  SELECT seq, ts_ns, (mid_pts - half_pts) / 1e6::DOUBLE AS bid, (mid_pts + half_pts) / 1e6::DOUBLE AS ask, mid_pts / 1e6::DOUBLE AS mid, 2 * half_pts / 1e6::DOUBLE AS spread,
         cents::DOUBLE AS volume, 1e6::DOUBLE * (1 + k % 50) AS bid_size, 1e6::DOUBLE * (1 + (k * 7) % 50) AS ask_size, mid_pts
  FROM walked
), fills AS (
  SELECT seq AS fill_id, seq, ts_ns, CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END AS sign,
         (mid_pts + CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END * half_pts) / 1e6::DOUBLE AS price, ((1 + cents % 20) * 1000)::DOUBLE AS size,
         'CP_' || lpad(cast(user_id % 40 AS VARCHAR), 3, '0') AS counterparty_id
  FROM walked WHERE event_type IN ('purchase', 'error')
)"""

DAILY_SQL = """
daily AS (
  SELECT cast(l_shipdate AS DATE) AS day, cast(round(sum(cast(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / count(*)) AS BIGINT) / 100::DOUBLE AS close,
         sum(cast(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT))::DOUBLE AS revenue
  FROM lineitem GROUP BY 1
)"""
