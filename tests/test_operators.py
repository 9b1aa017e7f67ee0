"""Small cases with known results, and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtide.operators import features, gate, indicators, labels, markouts, scoring, vpin
from flowtide.operators.gate import GateConfig, RiskGate
from flowtide.plans import series
from flowtide.sources import readers, synthetic
from flowtide.streaming.engine import Clock, Settings

S = 10**9


def ticks_of(spark, rows):
    """Ticks from (ts_ns, mid, volume)."""
    d = spark.createDataFrame([(i, int(t), float(m), float(v)) for i, (t, m, v) in enumerate(rows)], "seq long, ts_ns long, mid double, volume double")
    return d.withColumns({"bid": F.col("mid") - 5e-5, "ask": F.col("mid") + 5e-5, "spread": F.lit(1e-4), "bid_size": F.lit(1e6), "ask_size": F.lit(1e6)})


def fills_of(spark, rows):
    """Fills from (ts_ns, sign, price)."""
    return spark.createDataFrame([(i, i, int(t), s, float(p), 1000.0, "CP") for i, (t, s, p) in enumerate(rows)], "fill_id long, seq long, ts_ns long, sign int, price double, size double, counterparty_id string")


def test_asof_and_prefix_sums_across_slices(spark):
    t = ticks_of(spark, [(10, 1, 1), (20, 2, 1), (30, 3, 1), (40, 4, 1), (50, 5, 1)])
    probes = spark.createDataFrame([(i, i, q) for i, q in enumerate((5, 10, 25, 30, 999))], "fill_id long, seq long, ts_ns long")
    for width in (7, 1000):
        got = {r["fill_id"]: r["mid"] for r in series.asof(probes, t, ["mid"], slice_ns=width).collect()}
        assert got == {0: None, 1: 1.0, 2: 2.0, 3: 3.0, 4: 5.0}
        sums = {r["seq"]: r["s"] for r in series.prefix_sum(t, F.col("mid"), "s", slice_ns=width).collect()}
        assert sums == {0: 1, 1: 3, 2: 6, 3: 10, 4: 15}
        before = {r["seq"]: r["p"] for r in series.previous(t, {"p": "mid"}, slice_ns=width).collect()}
        assert before == {0: None, 1: 1, 2: 2, 3: 3, 4: 4}


def test_a_tick_may_fill_many_buckets(spark):
    one = vpin.buckets(ticks_of(spark, [(0, 1.1, 1000)]), 100).collect()
    many = vpin.buckets(ticks_of(spark, [(i, 1.1, 1) for i in range(1000)]), 100, slice_ns=90).collect()
    for got in (one, many):
        assert len(got) == 10 and all(r["v_buy"] + r["v_sell"] == 100 for r in got)
    with pytest.raises(ValueError):
        vpin.buckets(ticks_of(spark, [(0, 1, 1)]), 0)


def test_vpin_trend_is_above_balance(spark):
    level = {}
    for drift in (4e-5, 0.0):
        t = synthetic.trend_ticks(spark, 3000, drift=drift)
        r = vpin.vpin(t, 100_000.0, 20, granularity="tick").where("vpin is not null")
        level[drift] = r.agg(F.avg("vpin")).first()[0]
        assert r.where("vpin < 0 or vpin > 1").count() == 0
    assert level[4e-5] > 0.5 > level[0.0]


def test_streaming_clock_equals_batch(spark):
    t = synthetic.trend_ticks(spark, 1500, drift=1e-6).cache()
    want = {r["bucket"]: r for r in vpin.vpin(t, 100_000.0, 10).collect()}
    clock = Clock(Settings(100_000.0, window=10))
    got = []
    for i, r in enumerate(t.orderBy("ts_ns").collect()):
        if i == 700:
            clock = Clock(clock.s, clock.state())  # as between two batches
        got += clock.tick(r["ts_ns"], r["seq"], r["bid"], r["ask"], r["volume"])
    assert len(got) == len(want)
    for bucket, ts, mid, v_buy, imbalance, value, rank, *_ in got:
        w = want[bucket]
        assert ts == w["ts_end"] and imbalance == pytest.approx(w["order_imbalance"], abs=1e-9)
        assert value == (None if w["vpin"] is None else pytest.approx(w["vpin"], abs=1e-9))
        assert (rank is None) == (w["vpin_pctile"] is None)
    assert list(clock.tick(0, 0, 1.0, 1.1, 1.0)) == [] and clock.late == 1


def test_markouts(spark):
    t = ticks_of(spark, [(i * S, 1.1 + i * 1e-4, 1) for i in range(60)])
    m = {r["sign"]: r for r in markouts.markouts(fills_of(spark, [(0, 1, 1.1), (0, -1, 1.1)]), t, (1, 10, 30, 1000)).collect()}
    for sign in (1, -1):
        assert [m[sign][f"markout_{h}s"] for h in (1, 10, 30)] == pytest.approx([-1e-4 * sign, -1e-3 * sign, -3e-3 * sign])
        assert m[sign]["markout_1000s"] is None


def label_of(spark, rows, fill, **options):
    return labels.label(fills_of(spark, [fill]), ticks_of(spark, rows), **options).first()["label"]


def test_crossback(spark):
    rows = [(i * S, 1.1 + i * 1e-4, 1) for i in range(61)]
    cross = lambda fill, **o: label_of(spark, rows, fill, rule="crossback", **{"horizon_seconds": 30} | o)
    assert cross((0, 1, 1.1)) == 1 and cross((0, -1, 1.1)) == 0
    assert cross((0, 1, 1.1), min_adverse=1e-3) == 1 and cross((0, 1, 1.1), min_adverse=1e-2) == 0
    assert cross((0, 1, 1.1), horizon_seconds=600) == -1
    flat = [(i * S, 1.1, 1) for i in range(61)]
    assert label_of(spark, flat, (0, 1, 1.10005), rule="crossback", horizon_seconds=30) == 0
    assert label_of(spark, flat, (0, -1, 1.09995), rule="crossback", horizon_seconds=30) == 0


def test_triple_barrier(spark):
    rows = [(i * S, 1.1 - 1e-5 * min(i, 5) + 1e-4 * max(i - 5, 0), 1) for i in range(61)]
    for theta, want in ((5e-4, 1), (2e-5, 0)):
        assert label_of(spark, rows, (0, 1, 1.1), rule="triple_barrier", horizon_seconds=30, theta=theta) == want
    with pytest.raises(ValueError):
        label_of(spark, rows, (0, 1, 1.1), rule="other")


def test_counterparty_history(spark):
    def run(ys, cps, ts, **o):
        rows = [(i, i, t, c, y) for i, (y, c, t) in enumerate(zip(ys, cps, ts, strict=True))]
        d = spark.createDataFrame(rows, "fill_id long, seq long, ts_ns long, counterparty_id int, label int")
        return [(r["cp_toxic_rate_hist"], r["cp_fill_count"]) for r in features.counterparty_history(d, rate=0.5, weight=2, **o).orderBy("fill_id").collect()]

    got = run((1, 1, 1, 0, 0), (1, 1, 1, 2, 1), range(5))
    assert [got[i][0] for i in (0, 1, 3, 4)] == pytest.approx([0.5, 2 / 3, 0.5, 0.8]) and (got[0][1], got[4][1]) == (0, 3)
    late = run((1, 1, 0, 0), (1, 1, 1, 1), (0, 4, 5, 14), delay_seconds=1e-8)
    assert late[3][1] == 2 and (late[2][0], late[3][0]) == pytest.approx((0.5, 0.75))


def test_gate_hysteresis_and_pricing():
    g = RiskGate(GateConfig())
    steps = [(0.50, 0), (0.70, 0), (0.63, 0), (0.50, 0), (0.50, 2 * S), (0.90, 2 * S)]
    assert [g.update(t, p, 1e-4)[0] for p, t in steps] == ["normal", "widen", "widen", "widen", "normal", "suspend"]
    priced = RiskGate(GateConfig(alpha_mu=5e-5, suspend_above=0.99))
    action, multiplier, spread, _ = priced.update(0, 0.9, 3e-5)
    assert (action, multiplier, spread) == ("widen", pytest.approx(3), pytest.approx(9e-5))
    with pytest.raises(TypeError):
        GateConfig.of(nothing=1)


def test_model_files(spark):
    linear = scoring.LinearModel(["a", "b", "c"], [0, 1, 2], [1, 2, 4], [1, -2, 0.25], -0.5)
    rows = spark.createDataFrame([(1.0, 3.0, 6.0)], "a double, b double, c double")
    assert rows.select(linear.raw()).first()[0] == pytest.approx(-1.25)
    assert scoring.verify(linear, rows) <= 1e-12
    N = scoring.Node
    stumps = scoring.TreeModel(["x", "y"], 0.1, [[N(0, 0.5, 1, 2), N(-1, -1.0), N(-1, 1.0)], [N(1, 0.5, 1, 2), N(-1, -2.0), N(-1, 2.0)]])
    xs = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (float("nan"), None)], "x double, y double")
    assert [r[0] for r in xs.select(stumps.raw()).collect()] == pytest.approx([-2.9, 3.1, -2.9])
    assert scoring.load(scoring.dump(stumps)) == stumps
    data = scoring.dump(linear)
    for bad in (b"nope" + data[4:], data[:-3], data[:4] + b"\x01" + data[5:], b""):
        with pytest.raises(ValueError):
            scoring.load(bad)
    with pytest.raises(ValueError):
        linear.score(rows.drop("b"))
    assert scoring.bind(["b", "a"], ["a", "b"]) == [1, 0]


def test_ema_and_rsi(spark):
    import datetime

    closes = [10.0, 11.0, 10.5, 12.0, 12.0]
    bars = spark.createDataFrame([(datetime.date(2024, 1, i + 1), c) for i, c in enumerate(closes)], "day date, close double")
    got = [r["e"] for r in indicators.ema(bars, {"e": ("close", 3)}).orderBy("day").collect()]
    for i, e in enumerate(got):
        w = [0.5**k for k in range(i + 1)]
        assert e == pytest.approx(sum(a * b for a, b in zip(w, closes[i::-1])) / sum(w))
    rsi = [r["rsi"] for r in indicators.rsi(bars, 3).orderBy("day").collect()]
    assert rsi[:2] == [None, None] and rsi[2] == pytest.approx(100 - 100 / (1 + 1.0 / 0.5))


def test_fracdiff_in_parts_equals_one_pass(spark, monkeypatch):
    monkeypatch.setattr(features, "ROWS", 300, raising=False)
    day = 86_400_000_000_000
    xs = [None if i == 700 else math.sin(i) + i / 100 for i in range(1500)]
    d = spark.createDataFrame([(i * day // 50, i, x) for i, x in enumerate(xs)], "ts_ns long, seq long, mid double")
    made = features.frac_diff(d, "mid", 0.4)
    assert made.columns == ["ts_ns", "seq", "mid", "mid_ffd"]
    assert "_part" in made._jdf.queryExecution().toString()  # no window over the whole series
    got = {r["seq"]: r["mid_ffd"] for r in made.collect()}
    w = features.ffd_weights(0.4)
    assert len(got) == 1500 and len(w) == 282
    for i in range(1500):
        held = xs[max(0, i - len(w) + 1) : i + 1]
        if len(held) < len(w) or None in held:
            assert got[i] is None
        else:
            assert abs(got[i] - sum(a * b for a, b in zip(held, w))) < 1e-9


def test_fracdiff_weights():
    assert features.ffd_weights(0.0) == [1.0]
    assert features.ffd_weights(1.0)[-1] == 1.0 and features.ffd_weights(1.0)[-2] == -1.0
    w = features.ffd_weights(0.4, 1e-2)[::-1]
    assert all(w[k] == pytest.approx(-w[k - 1] * (0.4 - k + 1) / k) for k in range(1, len(w)))


def test_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    ducas = put("a.csv", "Gmt time,Ask,Bid,AskVolume,BidVolume\n01.02.2024 10:00:00.500,1.2,1.1,3,4\nbad,1,1,1,1\n")
    r = readers.read_ticks(spark, ducas).collect()
    assert len(r) == 1 and (r[0]["volume"], r[0]["ts_ns"] % S) == (7.0, 500_000_000)
    fx = put("b.csv", "EUR/USD,20240201 10:00:00.123,1.1,1.2\n")
    assert readers.read_ticks(spark, fx).first()["volume_is_proxy"]
    hist = put("c.csv", "20240201 100000;1.1;1.2;1.0;1.15;9\n")
    h = readers.read_ticks(spark, hist).first()
    assert (h["bid"], h["ask"], h["volume"]) == (pytest.approx(1.14996), pytest.approx(1.15004), 1.0)
    duka = put("d.csv", "time,ask,bid,ask_volume,bid_volume\n2024-02-01T10:00:00,1.2,1.1,1,2\n")
    assert readers.read_ticks(spark, duka).first()["bid_size"] == 2
    swapped = put("e.csv", "2024-02-01T10:00:00,1.1,1.2,1,2\n")
    with pytest.raises(ValueError):
        readers.read_duka(spark, swapped)
    blotter = put("f.csv", "timestamp,side,price,size\n2024-02-01T10:00:00,BUY,1.1,100\n")
    assert readers.read_blotter(spark, blotter).first()["counterparty_id"] == "unknown"
    with pytest.raises(ValueError):
        readers.read_blotter(spark, put("g.csv", "timestamp,side,price,size\n2024-02-01T10:00:00,hold,1.1,100\n"))


def test_hour_files(spark, tmp_path):
    import lzma
    import struct

    folder = tmp_path / "EURUSD" / "2024" / "01" / "05"
    folder.mkdir(parents=True)
    (folder / "10h_ticks.bi5").write_bytes(lzma.compress(struct.pack(">IIIff", 1500, 110010, 110000, 1.5, 2.0), format=lzma.FORMAT_ALONE))
    (folder / "11h_ticks.bi5").write_bytes(b"")
    rows = readers.read_hour_files(spark, str(tmp_path), "EURUSD").collect()
    assert len(rows) == 1 and rows[0]["bid"] == pytest.approx(1.1) and rows[0]["volume"] == pytest.approx(3.5e6)
    assert str(rows[0]["timestamp"]) == "2024-02-05 10:00:01.500000" and math.isclose(rows[0]["ask"], 1.1001)
    assert [d.isoformat() for d in readers.trading_days("2024-02-02", "2024-02-04")] == ["2024-02-02", "2024-02-04"]


def test_synthetic_and_gate_fold(spark):
    t = synthetic.synthetic_ticks(spark, 3000).cache()
    assert t.where("ask <= bid").count() == 0
    f = synthetic.synthetic_fills(t, 100)
    assert 0 < f.count() <= 100
    rows = f.withColumns({"proba": F.lit(0.7), "base_spread": F.lit(1e-4)})
    assert {r["action"] for r in gate.simulate(rows, "counterparty_id").collect()} == {"widen"}
    assert synthetic.lp_blotter(t, refresh_ticks=100, half_spread=1e-5, edge=1e-5).where("price is null").count() == 0
    assert synthetic.random_blotter(t, 10).count() == 10
    assert synthetic.split_ticks(t.limit(10), 4).count() == 40


@pytest.mark.parametrize("bins", [None, 16])
def test_percentile_over_slices_equals_brute_force(spark, bins):
    rng = np.random.default_rng(3)
    values = [None if i % 11 == 0 else float(rng.integers(0, 40)) / 40 for i in range(150)] + [0.5] * 30
    rows = [(name, i + 1, x) for name, n in (("a", 180), ("b", 37)) for i, x in enumerate(values[:n])]
    readings = spark.createDataFrame(rows, "symbol string, bucket long, vpin double")
    got = {(r.symbol, r.bucket): r.vpin_pctile for r in vpin.percentile(readings, 5, bins, ["symbol"], slice_buckets=8).collect()}
    step = lambda x: min(int(x * bins), bins - 1) if bins else x
    assert len(got) == len(rows)
    for name, i, x in rows:
        seen = [step(y) for n, j, y in rows if n == name and j <= i and y is not None]
        want = None if x is None or len(seen) < 5 else sum(y <= step(x) for y in seen) / len(seen)
        assert got[name, i] == (want if want is None else pytest.approx(want))


def test_percentile_of_no_readings(spark):
    assert vpin.percentile(spark.createDataFrame([], "bucket long, vpin double")).count() == 0
