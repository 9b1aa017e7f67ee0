"""Splits of events in time, with purging and embargo. Every split is rows (fold, role, event columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written
from ..plans.series import row_numbers, seconds

FOLDS, EMBARGO, MIN_TRAIN, TEST_SHARE = 5, 0.01, 0.4, 0.25


def _numbered(events: DataFrame) -> tuple[DataFrame, int, int, int]:
    """fill_id, ts_ns and row (from 0) of the events; their number, and first and last time."""
    d = row_numbers(events.select("fill_id", "ts_ns", "seq"), "_r").select("fill_id", "ts_ns", (F.col("_r") - 1).alias("row"))
    d = written(d, "numbered")  # read for its size, the bounds and the roles
    n, low, high = d.agg(F.count("*"), F.min("ts_ns"), F.max("ts_ns")).first()
    return d, n, low or 0, high or 0


def purged_kfold(events: DataFrame, horizon_seconds: float, folds: int = FOLDS, embargo: float = EMBARGO) -> DataFrame:
    """fold, role, fill_id, ts_ns: contiguous test folds; train rows whose label span [t, t + horizon] touches the
    test's, or that start within the embargo after it, are left out."""
    d, n, low, high = _numbered(events)
    if n < 2 * folds:
        raise ValueError(f"{folds} folds need at least {2 * folds} events")
    h, gap = seconds(horizon_seconds), round(embargo * max(high - low, 1))
    big, size = n % folds, n // folds  # the first folds hold one more
    fold = F.when(F.col("row") < big * (size + 1), F.floor(F.col("row") / (size + 1))).otherwise(big + F.floor((F.col("row") - big * (size + 1)) / max(size, 1))).cast("int")
    d = d.withColumn("own", fold)
    bounds = d.groupBy(F.col("own").alias("fold")).agg(F.min("ts_ns").alias("start"), (F.max("ts_ns") + h).alias("end"))
    pairs = d.crossJoin(F.broadcast(bounds))  # one row a fold
    test = F.col("own") == F.col("fold")
    clear = ((F.col("ts_ns") + h < F.col("start")) | (F.col("ts_ns") > F.col("end"))) & ~((F.col("ts_ns") > F.col("end")) & (F.col("ts_ns") <= F.col("end") + gap))
    return pairs.withColumn("role", F.when(test, "test").when(clear, "train")).where("role is not null").select("fold", "role", "fill_id", "ts_ns")


def walk_forward(events: DataFrame, horizon_seconds: float, folds: int = FOLDS, min_train: float = MIN_TRAIN, embargo: float = EMBARGO, expanding: bool = True) -> DataFrame:
    """fold, role, fill_id, ts_ns: tests of equal size one after the other, each trained on what came before and was
    known by then; not expanding keeps the last two folds' length."""
    d, n, low, high = _numbered(events)
    h, gap = seconds(horizon_seconds), round(embargo * max(high - low, 1))
    first = int(n * min_train)
    if first < 1 or n - first < folds:
        raise ValueError("too few events for these splits")
    size = (n - first) // folds
    plan = [(k, first + k * size, min(first + (k + 1) * size, n), 0 if expanding else max(0, first + k * size - 2 * size)) for k in range(folds)]
    starts = d.where(F.col("row").isin([p[1] for p in plan])).select(F.col("row").alias("lo"), F.col("ts_ns").alias("start"))
    spans = d.sparkSession.sql(" UNION ALL ".join(f"SELECT {k} AS fold, {lo}L AS lo, {hi}L AS hi, {a}L AS oldest" for k, lo, hi, a in plan)).join(starts, "lo")
    pairs = d.crossJoin(F.broadcast(spans))
    test = (F.col("row") >= F.col("lo")) & (F.col("row") < F.col("hi"))
    train = (F.col("row") >= F.col("oldest")) & (F.col("row") < F.col("lo")) & (F.col("ts_ns") + h <= F.col("start") - gap)
    return pairs.withColumn("role", F.when(test, "test").when(train, "train")).where("role is not null").select("fold", "role", "fill_id", "ts_ns")


def holdout(events: DataFrame, horizon_seconds: float, test_share: float = TEST_SHARE, embargo: float = EMBARGO) -> DataFrame:
    """role (dev, test), fill_id, ts_ns: the last share tests; dev rows must be known before the cutoff."""
    d, n, low, high = _numbered(events)
    first = int(n * (1 - test_share))
    if first < 1 or first >= n:
        raise ValueError("an empty development or test set")
    gap = round(embargo * max(high - low, 1))
    start = d.where(F.col("row") == first).select((F.col("ts_ns") - gap).alias("cutoff"))
    d = d.crossJoin(F.broadcast(start))
    dev = (F.col("row") < first) & (F.col("ts_ns") + seconds(horizon_seconds) < F.col("cutoff"))
    return d.withColumn("role", F.when(F.col("row") >= first, "test").when(dev, "dev")).where("role is not null").select("role", "fill_id", "ts_ns")


def split_report(splits: DataFrame) -> DataFrame:
    """fold, n_train, n_test, test_start, test_end."""
    test = F.col("role") == "test"
    return splits.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(test).alias("n_test"), F.min(F.when(test, F.col("ts_ns"))).alias("test_start"), F.max(F.when(test, F.col("ts_ns"))).alias("test_end"))


def assert_no_leakage(splits: DataFrame, horizon_seconds: float) -> None:
    """Raises where a train row's label span touches a test's."""
    h = seconds(horizon_seconds)
    tests = splits.where("role = 'test'").groupBy("fold").agg(F.min("ts_ns").alias("start"), (F.max("ts_ns") + h).alias("end"))
    bad = splits.where("role = 'train'").join(F.broadcast(tests), "fold").where((F.col("ts_ns") + h >= F.col("start")) & (F.col("ts_ns") <= F.col("end"))).count()
    if bad:
        raise AssertionError(f"{bad} train rows overlap their test fold")


