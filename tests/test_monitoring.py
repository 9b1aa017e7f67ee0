"""Drift reports, gated signals, the counterparty file and the properties of VPIN readings."""

import math

import pytest
from pyspark.sql import functions as F

from flowtide.operators import features, gate, metrics, validation
from flowtide.sources import readers, synthetic


def test_gated_signals(spark):
    rows = [(0, 1, 0.1), (1, -2, 0.4), (2, 1, 0.5), (3, 1, 1.7), (4, 1, -0.3), (5, 3, None), (6, 3, math.nan)]
    d = spark.createDataFrame(rows, "fill_id long, signal int, p double").withColumn("act", F.lit("clash"))
    got = {r.fill_id: (r.toxicity_proba, r.act, r.size_multiplier, r.gated_signal) for r in gate.gated_signals(d, "signal", "p", 0.5, dust=0.25).collect()}
    # A size of 1 - 0.4 / 0.5 is dust here.
    assert got[0] == (0.1, True, pytest.approx(0.8), pytest.approx(0.8)) and got[1] == (0.4, True, 0.0, 0.0)
    assert got[2] == (0.5, False, 0.0, 0.0) and got[3] == (1.0, False, 0.0, 0.0) and got[4] == (0.0, True, 1.0, 1.0)
    assert got[5] == got[6] == (None, False, 0.0, 0.0)


def test_drift_report(spark):
    d = spark.createDataFrame([(i / 40, int(i % 40 > 20)) for i in range(40)], "score double, label int")
    now = metrics.evaluate(d).first()
    r = metrics.drift_report(d, {"auc": 0.6, "brier_skill": 0.1, "other": 1.0}, bins=4).first()
    assert r.delta_auc == pytest.approx(now.auc - 0.6) and r.delta_brier_skill == pytest.approx(now.brier_skill - 0.1)
    assert "delta_other" not in r.asDict() and r.auc == now.auc
    worst = max(b.calibration_error for b in metrics.reliability(d, bins=4).collect())
    assert r.max_calibration_error == pytest.approx(worst)
    assert "delta_auc" not in metrics.drift_report(d).columns


def test_counterparty_file_comes_back(spark, tmp_path):
    labelled = spark.createDataFrame([("b", 1), ("a", 0), ("a", 1), ("a", -1), ("c", -1)], "counterparty_id string, label int")
    readers.write_counterparties_csv(features.counterparty_table(labelled), str(tmp_path / "cp.csv"))
    back = readers.read_counterparties(spark, str(tmp_path / "cp.csv"))
    assert [(r.code, r.toxic, r.total) for r in back.orderBy("code").collect()] == [(0, 1, 2), (1, 1, 1)]


def test_analytic_properties(spark):
    t = synthetic.trend_ticks(spark, 3000, drift=0.0)
    checks = {r.check: r for r in validation.analytic_properties(t, 500_000.0, 10).collect()}
    assert len(checks) == 8 and all(r.passed for r in checks.values()), checks
    few = {r.check: r.passed for r in validation.analytic_properties(t.limit(3), 1e9, 10).collect()}
    assert not few["vpin in [0, 1]"] and not few["unchanged by cut ticks"]
