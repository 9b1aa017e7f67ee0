"""Cross-validated models against plain Newton steps in numpy, fold by fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtide.operators import folds, metrics, splits

S = 1_000_000_000
COLUMNS = ["a", "b", "c"]


def made(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 50.0, 1e-4] + [0.0, 1000.0, 0.0]
    p = 1 / (1 + np.exp(-(1.2 * x[:, 0] - 0.02 * (x[:, 1] - 1000))))
    return x, (rng.random(n) < p).astype(int), np.sort(rng.integers(0, 5000, n)) * S


@pytest.fixture(scope="module")
def frame(spark):
    x, y, t = made()
    rows = [(i, int(t[i]), int(y[i]), *map(float, x[i])) for i in range(len(y))]
    d = spark.createDataFrame(rows, "fill_id long, ts_ns long, label int, a double, b double, c double").withColumn("seq", F.col("fill_id"))
    s = splits.walk_forward(d, 20.0, folds=3).cache()
    return d.cache(), s, (x, y, t)


def newton(z, t, penalty):
    w, ridge = np.zeros(z.shape[1]), np.append(np.full(z.shape[1] - 1, penalty), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - t) + ridge * w)
    return w


def plain_fit(x, y):
    mean, scale = x.mean(0), x.std(0)
    one = lambda v: np.hstack([(v - mean) / scale, np.ones((len(v), 1))])
    w = newton(one(x), y, 1.0)
    return lambda v: one(v) @ w


def plain_scores(x, y, test, calibrate):
    if not calibrate:
        return 1 / (1 + np.exp(-plain_fit(x, y)(test)))
    # Stratified parts: the class that comes first is laid out first, then dealt round the parts.
    sorted_first = np.sort((y != y[0]).astype(int))
    part = np.zeros(len(y), int)
    for k in (0, 1):
        sizes = [int(np.sum(sorted_first[i::3] == k)) for i in range(3)]
        part[(y != y[0]).astype(int) == k] = np.repeat(np.arange(3), sizes)
    total = 0
    for q in range(3):
        f = plain_fit(x[part != q], y[part != q])
        held = y[part == q]
        pos, neg = held.sum(), (1 - held).sum()
        target = np.where(held == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
        slope, shift = newton(np.stack([f(x[part == q]), np.ones(len(held))], 1), target, 0.0)
        total = total + 1 / (1 + np.exp(-(slope * f(test) + shift)))
    return total / 3


@pytest.mark.parametrize("calibrate", [False, True])
def test_scores_equal_plain_newton(frame, calibrate):
    d, s, (x, y, _) = frame
    # Slices far shorter than the series, so that ranks are carried from one to the next.
    v = folds.cross_validate(d, s, COLUMNS, calibrate, **({"slice_ns": 300 * S} if calibrate else {}))
    got = {(r["fold"], r["fill_id"]): r["score"] for r in v.scores.collect()}
    role = s.toPandas()
    n = 0
    for fold in range(3):
        at = {r: np.sort(role[(role.fold == fold) & (role.role == r)].fill_id.to_numpy()) for r in ("train", "test")}
        want = plain_scores(x[at["train"]], y[at["train"]], x[at["test"]], calibrate)
        assert np.allclose([got[fold, i] for i in at["test"]], want, atol=1e-8)
        n += len(want)
    assert n == len(got)
    refit = np.array([r["score"] for r in v.model.score(d, "score").orderBy("fill_id").collect()])
    assert np.allclose(refit, plain_scores(x, y, x, calibrate), atol=1e-8)
    by_fold = {r["fold"]: r for r in v.folds.collect()}
    one = metrics.evaluate(v.scores.where("fold = 1")).first()
    assert all(by_fold[1][m] == pytest.approx(one[m], abs=1e-12) for m in folds.METRICS)
    assert by_fold[1]["n_train"] == ((role.fold == 1) & (role.role == "train")).sum()
    assert v.overall.first()["n"] == len(got)


def test_single_features_selection_and_summary(frame):
    d, s, _ = frame
    single = folds.univariate_scores(d, s, COLUMNS).collect()
    assert {r["feature"] for r in single} == set(COLUMNS) and single[0]["feature"] == "a"
    own = folds.cross_validate(d, s, ["b"]).folds
    row = next(r for r in single if r["feature"] == "b")
    assert row["brier_skill"] == pytest.approx(own.agg(F.avg("brier_skill")).first()[0], abs=1e-10)
    assert row["auc_min"] == pytest.approx(own.agg(F.min("auc")).first()[0])
    picked = folds.forward_select(d, s, COLUMNS)
    assert picked.selected[:2] == ["a", "b"] and picked.history[0][1] == pytest.approx(single[0]["brier_skill"], abs=1e-10)
    # The first column needs the floor alone; no gain over it is asked.
    weak = folds.forward_select(d, s, ["a"], gain=10.0)
    assert weak.selected == ["a"] and folds.forward_select(d, s, COLUMNS, floor=0.99).selected == []
    table = {r["metric"]: r for r in folds.summarize(own).collect()}
    values = [r["auc"] for r in own.collect()]
    assert table["auc"]["mean"] == pytest.approx(np.mean(values)) and table["auc"]["std"] == pytest.approx(np.std(values, ddof=1))


def test_nulls_one_class_folds_and_constant_columns(spark):
    rows = [(i, i * S, 0 if i < 12 else i % 2, float(i % 5), 7.0) for i in range(40)]
    d = spark.createDataFrame([*rows, (100, 1, 1, None, 7.0), (101, 1, None, 1.0, 7.0), (102, 1, -1, 1.0, 7.0)], "fill_id long, ts_ns long, label int, a double, k double")
    plan = [(0, "train", i) for i in range(10)] + [(0, "test", i) for i in range(10, 20)] + [(1, "train", i) for i in range(30)] + [(1, "test", i) for i in (*range(30, 40), 100)]
    s = spark.createDataFrame(plan, "fold int, role string, fill_id long")
    v = folds.cross_validate(d, s, ["a", "k"])
    by = {r["fold"]: r for r in v.folds.collect()}
    assert by[0]["auc"] is None and by[0]["n_train"] == 10 and by[1]["n"] == 10
    assert {r["fill_id"] for r in v.scores.collect()} == set(range(30, 40))
    assert v.model.score(d, "p").where("fill_id = 100").first()["p"] is None
    with pytest.raises(ValueError):
        folds.cross_validate(d, s.limit(0), ["a"])
    nothing = folds.cross_validate(d.limit(0), s, ["a"])
    assert nothing.model is None and nothing.scores.count() == 0


def test_events_of_a_split_are_numbered_once(spark):
    events = spark.range(60).select(F.col("id").alias("fill_id"), (F.col("id") * 1_000_000_000).alias("ts_ns"), F.col("id").alias("seq"))
    plan = splits.walk_forward(events, 1.0, folds=3)
    assert "Window" not in plan._jdf.queryExecution().toString()  # else each reader of the splits numbers all events again
    assert plan.where("role = 'test'").count() == 36
