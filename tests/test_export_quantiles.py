"""Exported trees against the models they come from; exact quantiles against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from flowtide.operators import export, labels, learn, metrics, quantiles, scoring


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = []
    for i in range(600):
        a, b = rng.gauss(0, 1), rng.random()
        data.append((i, math.nan if i % 40 == 0 else a, b, int(a + 0.5 * b + rng.gauss(0, 0.5) > 0.3)))
    return spark.createDataFrame(data, "fill_id long, a double, b double, label int")


def test_exported_trees_score_like_the_model(spark, rows):
    fitted = learn.fit_trees(rows, ["a", "b"], trees=6)
    assert export.verify_fitted(fitted, rows) <= 1e-12
    model = export.exported(fitted)
    assert model.names == ["a", "b"] and len(model.trees) == 6 and model.sigmoid_scale == 2.0
    for tree in model.trees:
        seen = [0]
        for i, node in enumerate(tree):
            if node.feature >= 0:
                # Each node comes before those under it, the left branch first, and every node is reached once.
                assert node.left == i + 1 and node.right > node.left
                seen += [node.left, node.right]
        assert sorted(seen) == list(range(len(tree)))
    with pytest.raises(ValueError):
        export.verify_fitted(fitted, rows, limit=-1.0)


def test_exported_regression_takes_the_scaler_in(rows):
    clean = rows.where("NOT isnan(a)").withColumn("label", F.col("label").cast("double"))
    stages = [VectorAssembler(inputCols=["a", "b"], outputCol="x"), StandardScaler(inputCol="x", outputCol="z", withMean=True), LogisticRegression(featuresCol="z")]
    fitted = Pipeline(stages=stages).fit(clean)
    assert export.verify_fitted(fitted, clean) <= 1e-9
    assert export.exported(fitted).names == ["a", "b"]


def test_guards(rows):
    clean = rows.where("NOT isnan(a)").withColumn("label", F.col("label").cast("double"))
    assembler = VectorAssembler(inputCols=["a", "b"], outputCol="_features")
    trees = learn.fit_trees(clean, ["a", "b"], trees=2).stages[-1]
    scaled = Pipeline(stages=[assembler, StandardScaler(inputCol="_features", outputCol="z")]).fit(clean)
    with pytest.raises(ValueError, match="scaler"):
        export.exported(type(scaled)([*scaled.stages, trees]))
    with pytest.raises(NotImplementedError, match="calibration"):
        export.exported(type(scaled)([assembler, trees, trees]))
    with pytest.raises(NotImplementedError, match="calibration"):
        export.exported(scoring.LinearModel(["_logit"], [0.0], [1.0], [1.0], 0.0))
    forest = RandomForestClassifier(labelCol="label", featuresCol="_features", numTrees=2)
    with pytest.raises(TypeError):
        export.exported(Pipeline(stages=[assembler, forest]).fit(clean))


@pytest.mark.parametrize("kind", ["normal", "ties", "few", "wide", "huge"])
def test_quantiles_equal_numpy(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "BINS", 16)
    monkeypatch.setattr(quantiles, "FEW", 5)
    rng = np.random.default_rng(1)
    x = {"normal": rng.normal(size=500), "ties": rng.integers(0, 4, 500).astype(float), "few": np.array([3.0, 1.0, 2.0]), "wide": 10 ** rng.uniform(-8, 8, 300), "huge": np.array([-1.7e308, 1.7e308, 0.0, 5.0, 6.0, 7.0, 8.0])}[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (math.nan,)], "`a.x` double")
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
    assert quantiles.quantiles(df, "a.x", shares) == pytest.approx(np.quantile(x, shares, method="linear").tolist(), rel=1e-12)


def test_quantiles_of_nothing_and_bins(spark):
    none = spark.createDataFrame([(None,)], "x double")
    assert quantiles.quantiles(none, "x", [0.5]) == [None]
    assert [r.bin for r in metrics.quantile_bins(none, "x", 4).collect()] == [None]
    same = spark.createDataFrame([(2.0,)] * 5, "x double")
    assert {r.bin for r in metrics.quantile_bins(same, "x", 4).collect()} == {0}


def test_calibrated_threshold_gives_the_rate(spark):
    rng = np.random.default_rng(2)
    x = rng.exponential(1e-4, 400)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "fill_id long, excursion double")
    found = labels.calibrate_crossback(df, 0.3)
    assert found["min_adverse"] == pytest.approx(np.quantile(x, 0.7)) and found["toxic_rate"] == pytest.approx(0.3, abs=0.01)
    assert "error" in labels.calibrate_crossback(df, 0.3, high=1e-6)
