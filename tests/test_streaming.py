"""Streams against the batch operators over the same rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowtide.operators import features, vpin
from flowtide.queries import file_stream, in_order, streamed
from flowtide.sources import synthetic
from flowtide.streaming import engine, live
from flowtide.streaming.ranks import PAGE, Ranks

S = 10**9


def test_ranks_equal_sorted_counts():
    rng = random.Random(1)
    for bins in (1, 7, 1000, 65_536):
        ranks, seen = Ranks(bins), []
        for i in range(300):
            v = rng.choice([rng.random(), rng.random() ** 6, 0.0, 1.0, -0.5, 2.0])
            seen.append(min(max(int(v * bins), 0), bins - 1))
            assert ranks.observe(v) == sum(x <= seen[-1] for x in seen) / len(seen)
            if i == 150:  # as between two batches: only pages that changed are kept
                pages = {k: ranks.pages[k] for k in ranks.dirty}
                assert all(len(p) == PAGE for p in pages.values()) and len(pages) <= bins // PAGE + 1
                ranks = Ranks.of(bins, ranks.total, pages)
    assert Ranks(10).observe(float("nan")) == 1.0


def quotes(spark, n=900, symbols=2):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(symbols):
        ts, mid = 0, 1.1
        for i in range(n):
            ts += int(rng.choice([0, 1, 2, 400], p=[0.1, 0.5, 0.38, 0.02])) * S
            mid += rng.normal() * 1e-5
            half = rng.integers(1, 9) * 1e-5
            rows.append((f"s{k}", i, ts, float(mid - half), float(mid + half), float(mid), float(rng.integers(0, 5)), float(rng.integers(0, 3)) * 1e6, float(rng.integers(0, 3)) * 1e6))
    t = spark.createDataFrame(rows, "symbol string, seq long, ts_ns long, bid double, ask double, mid double, volume double, bid_size double, ask_size double")
    return t.withColumn("spread", F.col("ask") - F.col("bid"))


def test_engine_equals_batch_with_bins(spark, tmp_path):
    t = synthetic.trend_ticks(spark, 1500, drift=1e-6).withColumn("symbol", F.lit("A"))
    bad = t.limit(3).withColumns({"bid": F.col("ask"), "symbol": F.lit("A")})
    in_order(t.unionByName(bad), ["ts_ns", "seq"], str(tmp_path / "in"), 3)
    settings = engine.Settings(100_000.0, window=10)
    out = engine.stream(file_stream(spark, t, str(tmp_path / "in")), settings)
    got = {r.bucket: r for r in streamed(out, str(tmp_path)).collect()}
    readings = vpin.rolling(vpin.buckets(t, 100_000.0), 10)
    want = {r.bucket: r for r in vpin.percentile(readings, bins=settings.bins).collect()}
    assert got.keys() == want.keys() and len(want) > 60
    apart = [abs(got[b].vpin_pctile - want[b].vpin_pctile) for b in want if want[b].vpin_pctile is not None]
    # A reading on the edge of two bins may fall to either side by rounding.
    assert apart and sum(x > 1e-12 for x in apart) <= 1
    assert all((got[b].vpin_pctile is None) == (want[b].vpin_pctile is None) for b in want)


def test_live_features_equal_batch(spark, tmp_path):
    t = quotes(spark)
    rng = random.Random(5)
    last = {r.symbol: r.m for r in t.groupBy("symbol").agg(F.max("ts_ns").alias("m")).collect()}
    f = spark.createDataFrame([(i, s, -5 * S if i < 4 else rng.randint(0, m + 4000 * S), 1000.0) for i, (s, m) in enumerate(list(last.items()) * 60)], "fill_id long, symbol string, ts_ns long, size double")
    events = live.ticks_and_fills(t, f)
    in_order(events, ["ts_ns"], str(tmp_path / "in"), 5)
    got = {r.fill_id: r for r in streamed(live.feature_stream(file_stream(spark, events, str(tmp_path / "in")), 20.0, 120.0), str(tmp_path)).collect()}
    want = features.core_features(f.withColumn("seq", F.col("fill_id")), t, 20.0, 120.0, by=["symbol"]).collect()
    assert len(got) == len(want) == 120
    for w in want:
        for c in features.CORE:
            assert got[w.fill_id][c] == (None if w[c] is None else pytest.approx(w[c], rel=1e-9, abs=1e-12)), (c, w.ts_ns)
    assert sum(w.spread is None for w in want) > 0


def test_live_features_hold_the_window_alone():
    live_one = live.LiveFeatures(5.0, 30.0)
    rng = np.random.default_rng(0)
    kept = []
    for k in range(40):
        ts = np.arange(k * 50, k * 50 + 50) * S
        one = np.ones(50)
        live_one.extend(ts, np.arange(50), 1.1 + rng.normal(size=50) * 1e-5, 1.2 + one, one, one, one)
        live_one.evict(int(ts[-1]))
        kept.append(len(live_one.rows()))
    assert set(kept) == {31}
    before = live_one.late
    live_one.extend(*(np.array([x]) for x in (5, 5)), *(np.array([1.0]),) * 5)
    assert live_one.late == before + 1 and len(live_one.rows()) == 31
    # A fill whose window is gone has no features; one long after the last tick still has its quote.
    old, now = live_one.snapshot(np.array([1900 * S, 9999 * S]), np.ones(2)).to_dict("records")
    assert np.isnan(old["spread"]) and now["tick_rate"] == 0 and not np.isnan(now["spread"]) and now["dt_last_tick"] == 1.0


def test_live_history_equals_batch(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, i, (1000 + i * rng.randint(1, 2)) * S, rng.choice(["a", "a", "b", "c"]), rng.choice([0, 1, 1, -1])) for i in range(400)]
    f = spark.createDataFrame(rows, "fill_id long, seq long, ts_ns long, counterparty_id string, label int")
    events = live.fills_and_labels(f, f, 25.0)
    in_order(events, ["event_time"], str(tmp_path / "in"), 5)
    seeds = spark.createDataFrame([("a", 3, 10), ("z", 1, 1)], "counterparty_id string, toxic long, total long")
    want = {r.fill_id: r for r in features.counterparty_history(f, 25.0).collect()}
    for name, start, toxic, total in (("plain", None, 0, 0), ("seeded", seeds, 3, 10)):
        stream = live.history_stream(file_stream(spark, events, str(tmp_path / "in")), lateness="5 seconds", seeds=start)
        got = {r.fill_id: r for r in streamed(stream, str(tmp_path / name)).collect()}
        assert got.keys() == want.keys()
        for i, w in want.items():
            mine = w.counterparty_id == "a"
            n = w.cp_fill_count + total * mine
            bad = w.cp_toxic_rate_hist * (w.cp_fill_count + 5) - 2.5 + toxic * mine
            assert got[i].cp_fill_count == n and got[i].cp_toxic_rate_hist == pytest.approx((bad + 2.5) / (n + 5))


class _Kept:
    """A state variable that counts its calls."""

    def __init__(self, calls):
        self.value, self.calls = None, calls

    def exists(self):
        return self.value is not None

    def get(self):
        self.calls.append("get")
        return iter(self.value or []) if isinstance(self.value, list) or self.value is None else self.value

    def put(self, value):
        self.calls.append("put")
        self.value = list(value)

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.value = None


class _Handle:
    def __init__(self):
        self.calls, self.timers = [], []

    def getValueState(self, *_):
        return _Kept(self.calls)

    getListState = getValueState

    def registerTimer(self, at):
        self.timers.append(at)


def test_live_history_asks_the_state_a_few_times_a_batch():
    handle, processor = _Handle(), live._HistoryProcessor(0.5, 5.0)
    processor.init(handle)
    ts = np.arange(2000) * S
    rows = pd.concat(
        [
            pd.DataFrame({"kind": 0, "fill_id": np.arange(2000), "ts_ns": ts, "label": -1, "known_ns": np.nan}),
            pd.DataFrame({"kind": 1, "fill_id": np.arange(2000), "ts_ns": ts, "label": np.arange(2000) % 2, "known_ns": ts + 10 * S}),
        ]
    )
    (out,) = processor.handleInputRows(("a",), iter([rows]), None)
    assert out["cp_fill_count"].tolist() == [max(0, i - 9) for i in range(2000)]
    assert len(handle.timers) <= live.TIMERS and len(handle.calls) < 10

    class Expired:
        def getExpiryTimeInMs(self):
            return max(handle.timers)

    list(processor.handleExpiredTimer(("a",), None, Expired()))
    assert processor._totals() == (1000, 2000) and not processor.pending.exists()
