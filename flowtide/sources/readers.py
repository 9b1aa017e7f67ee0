"""Readers of quote files, blotters and counterparty tables, and writers for other tools."""

from __future__ import annotations

import lzma
import struct
from collections.abc import Iterator
from datetime import date, datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship
from ..functions.special import point_value, side_sign

# Time formats and column names of the providers' files.
DUKASCOPY_TIME, TRUEFX_TIME, HISTDATA_TIME = "dd.MM.yyyy HH:mm:ss.SSS", "yyyyMMdd HH:mm:ss.SSS", "yyyyMMdd HHmmss"
DUKA_COLUMNS = ("time", "ask", "bid", "ask_volume", "bid_volume")
TRUEFX_COLUMNS = ("symbol", "timestamp", "bid", "ask")
HISTDATA_COLUMNS = ("timestamp", "open", "high", "low", "close", "volume")
PROVIDERS = ("auto", "dukascopy", "duka", "truefx", "histdata", "generic")


def parse_time(column: Column, pattern: str | None = None) -> Column:
    """A UTC timestamp by the provider's pattern, else as ISO 8601, else null."""
    iso = F.try_to_timestamp(column)
    return F.coalesce(F.try_to_timestamp(column, F.lit(pattern)), iso) if pattern else iso


def _named(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower() for c in df.columns])


def _csv(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, **options)


def _headless(spark: SparkSession, path: str, columns: tuple[str, ...], **options) -> DataFrame:
    return spark.read.csv(path, header=False, schema=", ".join(f"{c} string" for c in columns), ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, **options)


def _require(df: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")


def finish(df: DataFrame) -> DataFrame:
    """Adds ts_ns, seq (input order), mid, spread, volume (1.0 where there is none) and volume_is_proxy; rows without a
    time, bid or ask go."""
    d = df.withColumns({c: F.expr(f"try_cast({c} AS double)") for c in ("bid", "ask", "volume", "bid_size", "ask_size") if c in df.columns})
    proxy = "volume" not in d.columns
    d = d.withColumn("volume", F.lit(1.0)) if proxy else d
    d = d.where("timestamp is not null and bid is not null and ask is not null").withColumn("seq", F.monotonically_increasing_id())
    return d.withColumns({"ts_ns": F.unix_micros("timestamp") * 1000, "mid": (F.col("bid") + F.col("ask")) / 2, "spread": F.col("ask") - F.col("bid"), "volume_is_proxy": F.lit(proxy)})


def read_dukascopy(spark: SparkSession, path: str) -> DataFrame:
    d = _named(_csv(spark, path))
    time = next((c for c in ("gmt time", "timestamp", "time") if c in d.columns), None)
    if time is None:
        raise ValueError("no time column")
    _require(d, "bid", "ask")
    d = d.withColumn("timestamp", parse_time(F.col(f"`{time}`"), DUKASCOPY_TIME))
    if {"askvolume", "bidvolume"} <= set(d.columns):
        d = d.withColumn("volume", F.expr("try_cast(askvolume AS double) + try_cast(bidvolume AS double)"))
    return finish(d.select("timestamp", "bid", "ask", *(["volume"] if "volume" in d.columns else [])))


def read_duka(spark: SparkSession, path: str) -> DataFrame:
    """Ask stands before bid. Raises where most quotes are crossed, as columns are then swapped."""
    d = _headless(spark, path, DUKA_COLUMNS).where("lower(time) <> 'time'")
    d = d.select(parse_time(F.col("time")).alias("timestamp"), "bid", "ask", F.col("bid_volume").alias("bid_size"), F.col("ask_volume").alias("ask_size"))
    d = finish(d.withColumn("volume", F.expr("try_cast(bid_size AS double) + try_cast(ask_size AS double)")))
    crossed = d.agg(F.avg((F.col("ask") < F.col("bid")).cast("double"))).first()[0]
    if crossed is not None and crossed > 0.5:
        raise ValueError("more than half of the quotes are crossed: are ask and bid swapped?")
    return d


def read_truefx(spark: SparkSession, path: str) -> DataFrame:
    d = _headless(spark, path, TRUEFX_COLUMNS)
    return finish(d.withColumn("timestamp", parse_time(F.col("timestamp"), TRUEFX_TIME)))


def read_histdata(spark: SparkSession, path: str, spread_pips: float = 0.8, pip: float = 1e-4) -> DataFrame:
    """Bars of one minute; quotes stand half of ``spread_pips`` around the close, volume counts 1."""
    d = _headless(spark, path, HISTDATA_COLUMNS, sep=";")
    close, half = F.expr("try_cast(close AS double)"), 0.5 * spread_pips * pip
    return finish(d.select(parse_time(F.col("timestamp"), HISTDATA_TIME).alias("timestamp"), (close - half).alias("bid"), (close + half).alias("ask")))


def read_generic(spark: SparkSession, path: str) -> DataFrame:
    d = _named(_csv(spark, path))
    _require(d, "timestamp", "bid", "ask")
    return finish(d.withColumn("timestamp", parse_time(F.col("timestamp"))))


def sniff(spark: SparkSession, path: str) -> str:
    """The provider that a file's first line looks like."""
    row = spark.read.text(path).limit(1).first()
    line = (row[0] if row else "").lower()
    fields = line.split(",")
    if "gmt time" in line:
        return "dukascopy"
    if "ask_volume" in line or "bid_volume" in line:
        return "duka"
    if line.count(";") >= 4:
        return "histdata"
    return "truefx" if len(fields) > 1 and fields[1].strip()[:1].isdigit() and not fields[0].strip()[:1].isdigit() else "generic"


def read_ticks(spark: SparkSession, path: str, provider: str = "auto") -> DataFrame:
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider: {provider!r}")
    provider = sniff(spark, path) if provider == "auto" else provider
    return {"dukascopy": read_dukascopy, "duka": read_duka, "truefx": read_truefx, "histdata": read_histdata, "generic": read_generic}[provider](spark, path)


def read_blotter(spark: SparkSession, path: str) -> DataFrame:
    """fill_id, seq, ts_ns, sign, price, size, counterparty_id ('unknown' where there is none); a side that is no side raises."""
    d = _named(_csv(spark, path))
    _require(d, "timestamp", "side", "price", "size")
    if "counterparty_id" not in d.columns:
        d = d.withColumn("counterparty_id", F.lit("unknown"))
    d = d.withColumns({"sign": side_sign(F.col("side")), "seq": F.monotonically_increasing_id()})
    if odd := [r[0] for r in d.where("sign is null").select("side").distinct().limit(5).collect()]:
        raise ValueError(f"sides that aren't buy or sell: {odd}")
    return d.select(F.col("seq").alias("fill_id"), "seq", (F.unix_micros(parse_time(F.col("timestamp"))) * 1000).alias("ts_ns"), "sign", F.col("price").cast("double"), F.col("size").cast("double"), F.coalesce("counterparty_id", F.lit("unknown")).alias("counterparty_id"))


def read_counterparties(spark: SparkSession, path: str) -> DataFrame:
    d = _named(_csv(spark, path))
    _require(d, "code", "toxic", "total")
    return d.withColumns({c: F.col(c).cast("long") for c in ("code", "toxic", "total")})


def read_hour_files(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Ticks of compressed hour files cached as .../YYYY/MM/DD/HHh_ticks.bi5, months counted from 0, one task a file.

    A record is big-endian: milliseconds into the hour, ask and bid in points, volumes of both in millions. Empty files
    are hours without ticks.
    """
    ship(spark)
    scale = point_value(symbol)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                year, month, day, hour = name.split("/")[-4:]
                start = datetime(int(year), int(month) + 1, int(day), int(hour[:2]), tzinfo=timezone.utc)
                raw = lzma.decompress(content) if len(content) else b""
                at = int(start.timestamp()) * 10**9
                rows = [(at + ms * 10**6, bid * scale, ask * scale, bv * 1e6, av * 1e6) for ms, ask, bid, av, bv in struct.iter_unpack(">IIIff", raw)]
                yield pd.DataFrame(rows, columns=["ts_ns", "bid", "ask", "bid_size", "ask_size"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bi5").option("recursiveFileLookup", "true").load(path).select("path", "content")
    d = files.mapInPandas(decode, "ts_ns long, bid double, ask double, bid_size double, ask_size double")
    d = d.withColumns({"timestamp": F.timestamp_micros(F.floor(F.col("ts_ns") / 1000).cast("long")), "volume": F.col("bid_size") + F.col("ask_size")})
    return finish(d)


def trading_days(first: date | str, last: date | str) -> list[date]:
    """The days of a range but Saturdays, for naming hour files."""
    from datetime import timedelta

    a, b = (date.fromisoformat(x) if isinstance(x, str) else x for x in (first, last))
    days = [a + timedelta(days=i) for i in range((b - a).days + 1)]
    out = [d for d in days if d.weekday() != 5]
    if not out:
        raise ValueError("no trading day in the range")
    return out


def write_ticks_csv(ticks: DataFrame, path: str, engine: bool = False) -> None:
    """timestamp, bid, ask, volume and sizes; or for the streaming engine ts_ns first."""
    sizes = [c for c in ("bid_size", "ask_size") if c in ticks.columns]
    time = F.col("ts_ns") if engine else F.timestamp_micros(F.floor(F.col("ts_ns") / 1000).cast("long")).alias("timestamp")
    ticks.select(time, "bid", "ask", "volume", *sizes).write.csv(path, header=True)


def write_blotter_csv(fills: DataFrame, path: str) -> None:
    d = fills.select(F.timestamp_micros(F.floor(F.col("ts_ns") / 1000).cast("long")).alias("timestamp"), F.when(F.col("sign") > 0, "buy").otherwise("sell").alias("side"), "price", "size", "counterparty_id")
    d.sort("timestamp").write.csv(path, header=True)


def write_counterparties_csv(table: DataFrame, path: str) -> None:
    """counterparty_id, code, toxic, total in one file, as read_counterparties() and the live history's seeds take it."""
    # One row a counterparty.
    table.select("counterparty_id", "code", "toxic", "total").orderBy("code").coalesce(1).write.csv(path, header=True)
