"""The one-call report on a market with a planted informed counterparty, and the command line over it."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowtide import __main__ as cli
from flowtide import report
from flowtide.operators import metrics, scoring
from flowtide.sources import readers

S = 1_000_000_000
START = 1_704_067_200 * S


def market(spark, n=5000, every=5, seed=3):
    """Ticks a second apart that drift up or down for a minute, and fills: the informed side with the drift."""
    rng = np.random.default_rng(seed)
    drift = np.repeat(rng.choice([-1, 1], n // 60 + 1), 60)[:n]
    mid = np.round(1.1 + np.cumsum(drift * 1.5e-5 + rng.normal(0, 1e-5, n)), 6)
    size = rng.integers(1, 50, (3, n)) * 1e5
    ts = START + np.arange(n) * S
    ticks = pd.DataFrame({"seq": np.arange(n), "ts_ns": ts, "bid": mid - 4e-5, "ask": mid + 4e-5, "mid": mid, "spread": 8e-5, "volume": size[0], "bid_size": size[1], "ask_size": size[2]})
    at = np.arange(0, n - 40, every) + 1
    informed = rng.random(len(at)) < 0.35
    sign = np.where(informed, drift[at], rng.choice([-1, 1], len(at)))
    who = np.where(informed, "SHARP", rng.choice(["CALM_A", "CALM_B"], len(at)))
    fills = pd.DataFrame({"fill_id": np.arange(len(at)), "seq": np.arange(len(at)), "ts_ns": ts[at] + S // 2, "sign": sign.astype("int32"), "price": mid[at] + sign * 4e-5, "size": 1e5, "counterparty_id": who})
    return spark.createDataFrame(ticks), spark.createDataFrame(fills)


SETTINGS = report.Settings(horizons=(1.0, 5.0, 30.0), label_horizon=30.0, vpin_window=10, buckets_per_day=2000, columns=("obi", "vpin", "cp_toxic_rate_hist", "rv_short"), folds=3, slice_ns=600 * S)


@pytest.fixture(scope="module")
def found(spark):
    return report.analyse(*market(spark), SETTINGS)


def test_finds_the_planted_flow(found):
    r = found.summary.first()
    assert r["status"] != "good" and r["auc"] > 0.6 and r["auc_low"] > 0.5 and r["brier_skill"] > 0 and r["monotonicity"] < -0.3
    assert "cp_toxic_rate_hist" in r["features"] and abs(r["auc_labels_anew"] - 0.5) < 0.1
    assert found.worst.first()["counterparty_id"] == "SHARP" and found.threshold is not None
    kept = found.matrix.agg(F.count("*").alias("n"), F.avg("label").alias("rate"), F.avg("markout_30s").alias("m")).first()
    assert (r["n_fills"], r["toxic_rate"]) == (kept["n"], pytest.approx(kept["rate"])) and r["net_edge_pips"] == pytest.approx(kept["m"] / 1e-4)
    assert r["adverse_pips"] == pytest.approx(r["spread_earned_pips"] - r["net_edge_pips"])
    losing, verdict = r["net_edge_pips"] < 0, (r["verdict"], r["status"])
    assert verdict == report.VERDICTS[losing, True, (r["gate_uplift_pct"] or 0) > 5]
    # The holdout lies after everything that was learnt from, and is scored by the model that was fitted before it.
    one = metrics.evaluate(found.tested).first()
    assert one["auc"] == pytest.approx(r["auc"]) and one["n"] == found.tested.count() > 150
    first = found.tested.agg(F.min("ts_ns")).first()[0]
    assert found.validation.scores.join(found.matrix.select("fill_id", "ts_ns"), "fill_id").agg(F.max("ts_ns")).first()[0] + 30 * S < first
    base = {b["model"]: b for b in found.baselines.collect()}
    assert base["base rate"]["auc"] == pytest.approx(0.5) and base["model"]["auc"] == pytest.approx(r["auc"])
    assert found.gate.agg(F.sum("n")).first()[0] == one["n"]


def test_text_and_command_line(spark, found, monkeypatch, capsys, tmp_path):
    said = report.text(found)
    assert found.summary.first()["verdict"] in said and "SHARP" in said
    ticks, fills = market(spark, 300)
    readers.write_ticks_csv(ticks, str(tmp_path / "ticks"))
    readers.write_blotter_csv(fills, str(tmp_path / "blotter"))
    given = []
    monkeypatch.setattr(cli, "analyse", lambda *args: given.append(args) or found)
    model = tmp_path / "m.fxm"
    args = ["--ticks", str(tmp_path / "ticks"), "--blotter", str(tmp_path / "blotter"), "--provider", "generic", "--label-horizon", "30", "--export", str(model)]
    assert cli.main(args, spark) == 0 and said in capsys.readouterr().out
    (t, f, s), = given
    assert t.count() == 300 and f.count() == fills.count() and (s.label_horizon, s.select) == (30.0, True)
    loaded = scoring.load(model.read_bytes())
    assert loaded.names == found.model.members[0].names
    history = readers.read_counterparties(spark, str(tmp_path / "m.cp.csv"))
    assert {r["counterparty_id"] for r in history.collect()} == {"SHARP", "CALM_A", "CALM_B"}
    with pytest.raises(SystemExit):
        cli.main([*args, "--calibrate"], spark)

    def failing(*_):
        raise ValueError("too few VPIN readings")

    monkeypatch.setattr(cli, "analyse", failing)
    assert cli.main(args, spark) == 1 and "too few VPIN readings" in capsys.readouterr().out


def test_what_cannot_be_judged_raises(spark):
    ticks, fills = market(spark, 200)
    with pytest.raises(ValueError, match="readings"):
        report.analyse(ticks, fills, report.Settings(horizons=(1.0, 5.0, 30.0), bucket_volume=1e9, slice_ns=600 * S))
    with pytest.raises(ValueError, match="volume"):
        report.analyse(ticks.withColumn("volume", F.lit(0.0)), fills, report.Settings())
