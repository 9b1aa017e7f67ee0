"""Fitted Spark ML models as models of the file format, and checks that nothing is lost on the way."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.ml.feature import StandardScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import LinearModel, Node, TreeModel, dump, load

#: Boosted trees give half the log odds.
MARGIN_SCALE = 2.0


def exported(model, columns: Sequence[str] | None = None) -> LinearModel | TreeModel:
    """The model of the file format that scores like ``model``: boosted trees or logistic regression of two classes,
    alone or at the end of a pipeline of an assembler and (logistic regression only) a scaler.

    ``columns`` names the inputs of a model without an assembler. Raises NotImplementedError for what the format cannot
    hold (calibration after the model, splits on categories), ValueError for a scaler in front of trees, TypeError for
    other models.
    """
    if isinstance(model, LinearModel | TreeModel):
        if "_logit" in model.names:
            raise NotImplementedError("a calibration is no part of the format; export the model before it")
        return model
    names, scaler = list(columns or ()), None
    if isinstance(model, PipelineModel):
        *before, last = model.stages
        if any(_is_model(s) for s in before):
            raise NotImplementedError("a calibration is no part of the format; export the model before it")
        for stage in before:
            if isinstance(stage, VectorAssembler):
                names = list(stage.getInputCols())
            elif isinstance(stage, StandardScalerModel):
                scaler = stage
            else:
                raise TypeError(f"cannot export the stage {type(stage).__name__}")
        model = last
    if isinstance(model, GBTClassificationModel):
        if scaler is not None:
            raise ValueError("a scaler in front of trees changes every split: fit them on the columns as they are")
        names = names or [f"f{i}" for i in range(model.numFeatures)]
        weighted = zip(model.trees, model.treeWeights, strict=True)
        return TreeModel(names, 0.0, [nodes_of(tree._call_java("rootNode"), weight) for tree, weight in weighted], MARGIN_SCALE)
    if isinstance(model, LogisticRegressionModel):
        if model.numClasses != 2:
            raise TypeError("cannot export more than two classes")
        n = model.numFeatures
        mean, scale = [0.0] * n, [1.0] * n
        if scaler is not None:
            mean = scaler.mean.toArray().tolist() if scaler.getWithMean() else mean
            scale = [s or 1.0 for s in scaler.std.toArray().tolist()] if scaler.getWithStd() else scale
        return LinearModel(names or [f"f{i}" for i in range(n)], mean, scale, model.coefficients.toArray().tolist(), model.intercept)
    raise TypeError(f"cannot export {type(model).__name__}")


def _is_model(stage) -> bool:
    return isinstance(stage, GBTClassificationModel | LogisticRegressionModel)


def nodes_of(root, weight: float = 1.0) -> list[Node]:
    """A fitted tree's nodes, each before those under it, the left ones first; leaves carry their value times ``weight``.

    Spark sends missing values to the right.
    """
    out: list[Node] = []
    waiting = [(root, -1, False)]
    while waiting:
        node, parent, is_right = waiting.pop()
        at = len(out)
        if parent >= 0:
            if is_right:
                out[parent].right = at
            else:
                out[parent].left = at
        if node.getClass().getSimpleName() == "LeafNode":
            out.append(Node(-1, float(node.prediction()) * weight))
            continue
        split = node.split()
        if split.getClass().getSimpleName() != "ContinuousSplit":
            raise NotImplementedError("splits on categories are no part of the format: encode them as numbers first")
        out.append(Node(int(split.featureIndex()), float(split.threshold()), default_left=False))
        waiting.append((node.rightChild(), at, True))
        waiting.append((node.leftChild(), at, False))
    return out


def verify_fitted(pipeline: PipelineModel, rows: DataFrame, limit: float = 1e-9) -> float:
    """The largest difference between a fitted pipeline's probabilities and those of its exported file; above ``limit``
    it raises."""
    again = load(dump(exported(pipeline)))
    own = pipeline.transform(rows).withColumn("_own", vector_to_array("probability")[1])
    apart = again.score(own, "_file").agg(F.max(F.abs(F.col("_own") - F.col("_file")))).first()[0] or 0.0
    if apart > limit:
        raise ValueError(f"scores differ by {apart}")
    return apart
