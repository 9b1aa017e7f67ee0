"""Holdout and gate scores against plain loops over the same draws."""

import math
import random

import numpy as np
import pytest

from flowtide.operators import holdout

SCHEMA = "ts_ns long, score double, label int, pnl double"


def rows(n=400, seed=2):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        label = rng.choice([0, 0, 1, -1])
        score = None if rng.random() < 0.03 else round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * (label == 1), 0.2))), 2)
        out.append((i * 500_000_000_000, score, label, None if rng.random() < 0.05 else rng.gauss(0.1 - 0.3 * (label == 1), 1)))
    return out


def draws_of(blocks, n):
    names = sorted(set(blocks))
    rng = np.random.default_rng(0)
    for _ in range(n):
        yield [k for name in (names[j] for j in rng.integers(0, len(names), len(names))) for k, b in enumerate(blocks) if b == name]


def auc_and_skill(pairs):
    pos, neg = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    if not pos or not neg:
        return None
    won = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    base = len(pos) / len(pairs)
    return won / len(pos) / len(neg), 1 - sum((s - y) ** 2 for s, y in pairs) / len(pairs) / (base * (1 - base))


def test_holdout_scores_equal_resampled_rows(spark):
    data = rows()
    got = holdout.holdout_scores(spark.createDataFrame(data, SCHEMA).withColumn("hour", holdout.hour_blocks()).repartition(3), "hour", draws=40).first()
    known = [(t // holdout.HOUR_NS, s, y) for t, s, y, _ in data if s is not None and y >= 0]
    point = auc_and_skill([(s, y) for _, s, y in known])
    assert (got.n, got.auc, got.brier_skill) == (len(known), pytest.approx(point[0]), pytest.approx(point[1]))
    values = [v for idx in draws_of([b for b, _, _ in known], 40) if (v := auc_and_skill([known[i][1:] for i in idx]))]
    for k, name in enumerate(("auc", "brier_skill")):
        low, high = np.quantile([v[k] for v in values], [0.025, 0.975])
        assert (got[f"{name}_low"], got[f"{name}_high"]) == (pytest.approx(low), pytest.approx(high))


def test_gate_scores_equal_resampled_rows(spark):
    data = rows()
    got = holdout.gate_scores(spark.createDataFrame(data, SCHEMA).withColumn("hour", holdout.hour_blocks()), 0.5, "hour", draws=60).first()
    known = [(t // holdout.HOUR_NS, s, x) for t, s, _, x in data if s is not None and x is not None]
    blocked, total = [x for _, s, x in known if s >= 0.5], sum(x for _, _, x in known)
    assert got.blocked_share == pytest.approx(len(blocked) / len(known)) and got.pnl_ungated == pytest.approx(total)
    assert got.pnl_gated == pytest.approx(total - sum(blocked)) and got.uplift == pytest.approx(-sum(blocked) / abs(total))
    assert got.mean_pnl_blocked == pytest.approx(np.mean(blocked))
    values = []
    for idx in draws_of([b for b, _, _ in known], 60):
        part = [known[i] for i in idx]
        values.append(-sum(x for _, s, x in part if s >= 0.5) / abs(sum(x for _, _, x in part)))
    low, high = np.quantile(values, [0.025, 0.975])
    assert (got.uplift_low, got.uplift_high) == (pytest.approx(low), pytest.approx(high))


def test_one_class_no_rows_and_odd_rows(spark):
    def one(data):
        d = spark.createDataFrame(data, SCHEMA).withColumn("hour", holdout.hour_blocks())
        return holdout.holdout_scores(d, "hour", draws=5).first(), holdout.gate_scores(d, 0.5, "hour", draws=5).first()

    scores, gate = one([])
    assert scores.n == 0 and scores.auc_low is None and gate.blocked_share is None and gate.uplift_low is None
    scores, gate = one([(0, 0.4, 1, 0.0), (1, 0.6, 1, 0.0), (None, 0.5, 1, 0.0), (5, math.nan, 0, math.nan)])
    assert scores.auc is None and scores.auc_low is None and gate.pnl_ungated == 0 and gate.uplift is None and gate.uplift_high is None


def test_rows_moved_do_not_grow_with_draws(spark):
    d = spark.createDataFrame(rows(), SCHEMA).withColumn("hour", holdout.hour_blocks())
    for draws in (10, 300):
        assert holdout.bootstrap_ranks(d, "hour", draws=draws).count() == draws
    plan = holdout.bootstrap_ranks(d, "hour", draws=300)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "CartesianProduct" not in plan
