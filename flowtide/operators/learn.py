"""Models of toxicity: fitting, calibration and selection on Spark ML, and linear scores as expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import metrics
from .scoring import LinearModel

KINDS = ("logistic", "gbdt")


def fit_logistic(train: DataFrame, columns: Sequence[str], label: str = "label", c: float = 1.0) -> LinearModel:
    """Ridge-penalised logistic regression on inputs scaled by their population deviation; a constant input scales by 1."""
    stats = train.agg(F.count("*").alias("n"), *[F.avg(x).alias(f"m_{i}") for i, x in enumerate(columns)], *[F.stddev_pop(x).alias(f"s_{i}") for i, x in enumerate(columns)]).first()
    mean = [stats[f"m_{i}"] for i in range(len(columns))]
    scale = [stats[f"s_{i}"] or 1.0 for i in range(len(columns))]
    scaled = train.select(F.col(label).cast("double").alias("label"), *[((F.col(x) - mean[i]) / scale[i]).alias(f"x{i}") for i, x in enumerate(columns)])
    data = VectorAssembler(inputCols=[f"x{i}" for i in range(len(columns))], outputCol="features").transform(scaled)
    fitted = LogisticRegression(regParam=1 / (c * stats["n"]), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-9).fit(data)
    return LinearModel(list(columns), mean, scale, fitted.coefficients.toArray().tolist(), fitted.intercept)


def fit_predict(train: DataFrame, test: DataFrame, columns: Sequence[str], kind: str = "logistic", label: str = "label", out: str = "score") -> DataFrame:
    """``test`` with the probability of label 1 by a model fitted on ``train``."""
    if kind == "logistic":
        return fit_logistic(train, columns, label).score(test, out)
    if kind != "gbdt":
        raise ValueError(f"unknown kind: {kind!r}")
    return fit_trees(train, columns, label).transform(test).withColumn(out, vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")


def fit_trees(train: DataFrame, columns: Sequence[str], label: str = "label", trees: int = 120) -> PipelineModel:
    """Gradient-boosted trees on the columns as they are. Rows with missing inputs are scored, to the right of every split
    on them, but not fitted on."""
    boosted = GBTClassifier(labelCol=label, featuresCol="_features", maxDepth=3, maxIter=trees, stepSize=0.05, subsamplingRate=0.8, minInstancesPerNode=60, seed=0)
    assembler = VectorAssembler(inputCols=list(columns), outputCol="_features", handleInvalid="keep")
    return Pipeline(stages=[assembler, boosted]).fit(train.dropna(subset=list(columns)).withColumn(label, F.col(label).cast("double")))


def calibrate(scored: DataFrame, score: str = "score", label: str = "label") -> LinearModel:
    """A sigmoid over the logit of a score (Platt's scaling), to be applied to the column _logit."""
    return fit_logistic(with_logit(scored, score), ["_logit"], label, c=1e6)


def with_logit(scored: DataFrame, score: str = "score") -> DataFrame:
    p = F.least(F.greatest(F.col(score), F.lit(1e-9)), F.lit(1 - 1e-9))
    return scored.withColumn("_logit", F.log(p / (1 - p)))


def cross_validate(data: DataFrame, splits: DataFrame, columns: Sequence[str], kind: str = "logistic", label: str = "label", key: str = "fill_id") -> tuple[DataFrame, DataFrame]:
    """(out-of-fold rows with fold and score, a row of metrics for each fold). Folds whose training rows are of one class
    are passed over. ``data`` is read once a fold: cache it."""
    folds = [r[0] for r in splits.select("fold").distinct().orderBy("fold").collect()]
    rows, scores = None, None
    for fold in folds:
        part = splits.where(F.col("fold") == fold).select(key, "role")
        train, test = (data.join(part.where(F.col("role") == role).select(key), key) for role in ("train", "test"))
        if train.select(label).distinct().count() < 2:
            continue
        out = fit_predict(train, test, columns, kind, label).withColumn("fold", F.lit(fold))
        one = metrics.evaluate(out, "score", label).withColumn("fold", F.lit(fold))
        rows, scores = (out, one) if rows is None else (rows.unionByName(out), scores.unionByName(one))
    if rows is None:
        raise ValueError("no fold has both classes to train on")
    return rows, scores


def forward_select(data: DataFrame, splits: DataFrame, columns: Sequence[str], most: int = 8, gain: float = 0.002, floor: float = 0.0, metric: str = "brier_skill", **options) -> list[str]:
    """Adds the column with the best mean fold metric until that is below ``floor`` or less than ``gain`` above the last
    (the first column needs the floor alone). For logistic models folds.forward_select does this in a few scans."""
    chosen: list[str] = []
    best = None
    while len(chosen) < most:
        tried = {}
        for c in columns:
            if c not in chosen:
                _, scores = cross_validate(data, splits, [*chosen, c], **options)
                tried[c] = scores.agg(F.avg(metric)).first()[0]
        tried = {c: v for c, v in tried.items() if v is not None}
        if not tried:
            break
        c = max(sorted(tried), key=lambda x: tried[x])
        if tried[c] < floor or (best is not None and tried[c] - best < gain):
            break
        chosen.append(c)
        best = tried[c]
    return chosen


def importance(model: LinearModel) -> list[tuple[str, float]]:
    return sorted(zip(model.names, model.weights, strict=True), key=lambda x: -abs(x[1]))
