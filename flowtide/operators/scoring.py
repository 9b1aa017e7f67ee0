"""Models as files and as expressions: the engine's binary format, linear scores and trees."""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import sigmoid

# Fixed values of the format: magic, version, kinds, flags and the longest name.
MAGIC, VERSION, LOGISTIC, GBDT, SCALED, LONGEST_NAME = b"FXTM", 2, 0, 1, 1, 4096


@dataclass
class LinearModel:
    names: list[str]
    mean: list[float]
    scale: list[float]
    weights: list[float]
    bias: float
    sigmoid_scale: float = 1.0

    def raw(self) -> Column:
        total = F.lit(self.bias)
        for name, m, s, w in zip(self.names, self.mean, self.scale, self.weights, strict=True):
            total = total + (F.col(name) - m) / (s or 1.0) * w
        return total

    def score(self, rows: DataFrame, out: str = "score") -> DataFrame:
        """``rows`` with the probability as one expression, in code generation; missing inputs give null."""
        bind(self.names, rows.columns)
        return rows.withColumn(out, sigmoid(self.raw() * self.sigmoid_scale))


@dataclass
class Node:
    """A split (``feature`` 0 or above) or a leaf; missing values go left where ``default_left``."""

    feature: int
    value: float
    left: int = -1
    right: int = -1
    default_left: bool = True


@dataclass
class TreeModel:
    names: list[str]
    base: float
    trees: list[list[Node]] = field(default_factory=list)
    sigmoid_scale: float = 1.0

    def raw(self) -> Column:
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + self._at(tree, 0)
        return total

    def _at(self, tree: Sequence[Node], i: int) -> Column:
        n = tree[i]
        if n.feature < 0:
            return F.lit(n.value)
        x = F.col(self.names[n.feature])
        missing = x.isNull() | F.isnan(x)
        left = (missing & F.lit(n.default_left)) | (~missing & (x <= n.value))
        return F.when(left, self._at(tree, n.left)).otherwise(self._at(tree, n.right))

    def score(self, rows: DataFrame, out: str = "score") -> DataFrame:
        bind(self.names, rows.columns)
        return rows.withColumn(out, sigmoid(self.raw() * self.sigmoid_scale))


def bind(names: Sequence[str], columns: Sequence[str]) -> list[int]:
    """The place of each name among the columns; missing ones raise."""
    if missing := [n for n in names if n not in columns]:
        raise ValueError(f"missing features: {missing}")
    return [list(columns).index(n) for n in names]


def dump(model: LinearModel | TreeModel) -> bytes:
    linear = isinstance(model, LinearModel)
    out = [MAGIC, struct.pack("<IIIId", VERSION, LOGISTIC if linear else GBDT, len(model.names), SCALED if linear else 0, model.sigmoid_scale), struct.pack("<I", len(model.names))]
    for name in model.names:
        raw = name.encode()
        if len(raw) > LONGEST_NAME:
            raise ValueError("a feature's name is too long")
        out.append(struct.pack("<I", len(raw)) + raw)
    if linear:
        n = len(model.names)
        out.append(struct.pack(f"<{3 * n + 1}d", *model.mean, *model.scale, model.bias, *model.weights))
    else:
        out.append(struct.pack("<dI", model.base, len(model.trees)))
        for tree in model.trees:
            out.append(struct.pack("<I", len(tree)))
            out += [struct.pack("<iiiid", n.feature, n.left, n.right, int(n.default_left), n.value) for n in tree]
    return b"".join(out)


def load(data: bytes) -> LinearModel | TreeModel:
    """The model of a file's bytes; a wrong magic or version, a cut-off file and bad names raise ValueError."""
    at = 0

    def take(form: str) -> tuple:
        nonlocal at
        size = struct.calcsize("<" + form)
        if at + size > len(data):
            raise ValueError("the file is cut off")
        at += size
        return struct.unpack_from("<" + form, data, at - size)

    if take("4s")[0] != MAGIC:
        raise ValueError("not a model file")
    version, kind, n, flags, scale = take("IIIId")
    if version != VERSION:
        raise ValueError(f"version {version} is not supported")
    (count,) = take("I")
    if count not in (0, n):
        raise ValueError("the number of names doesn't match")
    names = []
    for _ in range(count):
        (size,) = take("I")
        if size > LONGEST_NAME:
            raise ValueError("a feature's name is too long")
        names.append(take(f"{size}s")[0].decode())
    names = names or [f"f{i}" for i in range(n)]
    mean, spread = ([0.0] * n, [1.0] * n) if not flags & SCALED else (list(take(f"{n}d")), [x or 1.0 for x in take(f"{n}d")])
    if kind == LOGISTIC:
        (bias,) = take("d")
        return LinearModel(names, mean, spread, list(take(f"{n}d")), bias, scale)
    if kind != GBDT:
        raise ValueError(f"unknown kind {kind}")
    base, trees = take("dI")
    model = TreeModel(names, base, sigmoid_scale=scale)
    for _ in range(trees):
        (size,) = take("I")
        nodes = [take("iiiid") for _ in range(size)]
        model.trees.append([Node(f, v, left, right, bool(d)) for f, left, right, d, v in nodes])
    return model


def verify(model: LinearModel | TreeModel, rows: DataFrame, limit: float = 1e-9) -> float:
    """The largest difference between the model's scores and those of its own file; above ``limit`` it raises."""
    again = load(dump(model))
    d = again.score(model.score(rows, "_a"), "_b").agg(F.max(F.abs(F.col("_a") - F.col("_b")))).first()[0] or 0.0
    if d > limit:
        raise ValueError(f"scores differ by {d}")
    return d
