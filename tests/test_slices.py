"""Computations in slices against one pass over everything, with slices small enough to matter."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtide.operators import indicators, vpin
from flowtide.plans import series
from flowtide.sources import synthetic


@pytest.mark.parametrize("keep, rows, least", [(0.9, 7, 1e-100), (0.9999, 5, 1e-100), (1.0, 6, 1e-100), (0.3, 4096, 1e-4), (0.0, 9, 1e-100)])
def test_decayed_sums_equal_a_loop(spark, monkeypatch, keep, rows, least):
    monkeypatch.setattr(series, "DECAY_ROWS", rows)
    monkeypatch.setattr(series, "DECAY_LEAST", least)
    rng = random.Random(3)
    data = [(k, i + 1, None if rng.random() < 0.2 else rng.gauss(0, 1)) for k in ("a", "b") for i in range(150 if k == "a" else 3)]
    df = spark.createDataFrame(data, "k string, _i long, x double").repartition(3)
    found = series.decayed_sums(df, {"s": F.col("x"), "n": F.col("x").isNotNull().cast("double")}, keep, ["k"])
    assert found.columns == ["k", "_i", "x", "s", "n"]
    got = {(r.k, r._i): r for r in found.collect()}
    assert len(got) == len(data)
    total = {}
    for k, i, x in data:
        s, n = total.get(k, (0.0, 0.0))
        total[k] = s, n = s * keep + (x or 0.0), n * keep + (x is not None)
        # Factors below the least of a slice are cut off.
        assert got[k, i].s == pytest.approx(s, rel=1e-9, abs=max(1e-12, 20 * least if least > 1e-9 else 0))
        assert got[k, i].n == pytest.approx(n, rel=1e-9, abs=max(1e-12, 20 * least if least > 1e-9 else 0))


def test_ema_has_no_array_of_a_whole_series(spark, monkeypatch):
    monkeypatch.setattr(series, "DECAY_ROWS", 8)
    bars = spark.createDataFrame([(f"d{i:03}", None if i % 11 == 3 else float(i % 7)) for i in range(120)], "day string, close double")
    found = indicators.ema(bars, {"e": ("close", 9)})
    assert "collect_list" not in found._jdf.queryExecution().toString()
    num = den = 0.0
    for r in sorted(found.collect(), key=lambda r: r.day):
        num, den = num * 0.8 + (r.close or 0.0), den * 0.8 + (r.close is not None)
        assert r.e == pytest.approx(num / den)
    assert indicators.ema(bars.limit(0), {"e": ("close", 9)}).collect() == []


def test_numbered_follows_the_order(spark):
    rng = random.Random(1)
    days = rng.sample(range(1000), 200)
    df = spark.createDataFrame([(k, f"{d:04}") for k in ("x", "y") for d in days], "k string, day string").repartition(5)
    for by in ([], ["k"]):
        got = series.numbered(df if by else df.where("k = 'x'"), "day", "i", by).collect()
        for k in ("x", "y"):
            rows = sorted((r.day, r.i) for r in got if r.k == k)
            assert not rows or [i for _, i in rows] == list(range(1, 201))


def test_vpin_in_small_slices_equals_one(spark, monkeypatch):
    t = synthetic.trend_ticks(spark, 700, drift=1e-6).cache()
    for options in ({}, {"granularity": "tick"}, {"sigma": 1e-5}):
        want = {r.bucket: r for r in vpin.vpin(t, 100_000.0, 7, pctile_warmup=3, **options).collect()}
        monkeypatch.setattr(vpin, "SLICE_BUCKETS", 10)
        readings = vpin.rolling(vpin.buckets(t, 100_000.0, **options), 7)
        got = {r.bucket: r for r in vpin.percentile(readings, 3, slice_buckets=10).collect()}
        monkeypatch.setattr(vpin, "SLICE_BUCKETS", 4096)
        assert got.keys() == want.keys() and len(want) > 40
        for b, w in want.items():
            assert got[b].warmup == w.warmup and got[b].ts_end == w.ts_end
            for c in ("dp", "v_buy", "order_imbalance", "vpin", "vpin_pctile"):
                assert got[b][c] == (None if w[c] is None else pytest.approx(w[c], rel=1e-7, abs=1e-9)), (b, c)


def test_ranks_so_far():
    rng = np.random.default_rng(0)
    values = np.where(rng.random(700) < 0.1, np.nan, rng.integers(0, 40, 700) / 40)
    for block in (1, 64, 4096):
        got = vpin.ranks_so_far(values, block)
        assert got.tolist() == [int(sum(v <= values[i] for v in values[: i + 1])) for i in range(700)]
