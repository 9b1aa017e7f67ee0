"""Whitening of embeddings: mean and covariance by Welford's streaming rank-one updates, one state a partition, states
merged by the parallel update formula; a symmetric QR iteration gives the axes, and every row is projected on them.

Only states travel: a count, exact sums, a mean and a co-moment matrix, whose size is set by the dimensions alone. They
are merged in two rounds of tasks before at most ``MERGERS`` of them reach the driver. The merged state and the axes are
computed once and passed to all later tasks, so rows computed again after a lost executor are projected on the same axes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed_row, partitions, unpacked, written

#: Entries become floor(SCALE * c) + OFFSET.
SCALE = 1024
OFFSET = 100_000
#: An entry of this size or more does not fit the grid of whole numbers and counts as not finite.
LARGEST = float(1 << 40)
#: States that reach the driver.
MERGERS = 16

_STATE = "n long, sums array<decimal(38,0)>, mean array<double>, comoment array<double>"


@dataclass
class Moments:
    """Count, exact per-dimension sums, mean, and the sum of outer products of deviations from the mean."""

    n: int
    sums: list[int]
    mean: np.ndarray
    comoment: np.ndarray

    @classmethod
    def zero(cls, dims: int) -> Moments:
        return cls(0, [0] * dims, np.zeros(dims), np.zeros((dims, dims)))

    def add(self, x: np.ndarray) -> None:
        """Welford's rank-one updates, row by row; ``x`` has a row for each vector."""
        for row in x:
            self.n += 1
            before = row - self.mean
            self.mean += before / self.n
            self.comoment += np.multiply.outer(before, row - self.mean)

    def merge(self, other: Moments) -> Moments:
        """The state of both lists together."""
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        apart = other.mean - self.mean
        comoment = self.comoment + other.comoment + np.outer(apart, apart) * (self.n * other.n / n)
        sums = [a + b for a, b in zip(self.sums, other.sums)]
        return Moments(n, sums, self.mean + apart * (other.n / n), comoment)

    @property
    def covariance(self) -> np.ndarray:
        """With divisor n, and exactly symmetric."""
        return (self.comoment + self.comoment.T) / (2 * self.n)


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix.

    Householder reflections make the matrix tridiagonal, QR steps with Wilkinson's shift make it diagonal, both gathered
    in one orthogonal matrix; one Gram-Schmidt pass at the end takes away what rounding left.
    """
    a = np.array(a, dtype=np.float64)
    d = len(a)
    q = np.eye(d)
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        norm = np.linalg.norm(v)
        if norm == 0.0:
            continue
        v[0] += np.copysign(norm, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :, :] -= 2.0 * np.outer(v, v @ a[k + 1 :, :])
        a[:, k + 1 :] -= 2.0 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2.0 * np.outer(q[:, k + 1 :] @ v, v)
    diagonal, beside = np.diagonal(a).copy(), np.append(np.diagonal(a, -1).copy(), 0.0)
    tiny = np.finfo(float).eps
    for low in range(d):
        while True:
            high = low
            while high < d - 1 and abs(beside[high]) > tiny * (abs(diagonal[high]) + abs(diagonal[high + 1])):
                high += 1
            if high == low:
                beside[low] = 0.0
                break
            _chase(diagonal, beside, q, low, high)
    order = np.argsort(-diagonal, kind="stable")
    vectors, _ = np.linalg.qr(q[:, order])
    return diagonal[order], vectors * np.sign(np.einsum("ij,ij->j", vectors, q[:, order]))


def _chase(diagonal: np.ndarray, beside: np.ndarray, q: np.ndarray, low: int, high: int) -> None:
    """One implicit step on the block low..high; the bulge is chased from its lower end to its upper one by rotations."""
    g = (diagonal[low + 1] - diagonal[low]) / (2.0 * beside[low])
    r = np.hypot(g, 1.0)
    g = diagonal[high] - diagonal[low] + beside[low] / (g + np.copysign(r, g))
    sine = cosine = 1.0
    p = 0.0
    for i in range(high - 1, low - 1, -1):
        f, b = sine * beside[i], cosine * beside[i]
        r = np.hypot(f, g)
        beside[i + 1] = r
        if r == 0.0:
            diagonal[i + 1] -= p
            beside[high] = 0.0
            return
        sine, cosine = f / r, g / r
        g = diagonal[i + 1] - p
        r = (diagonal[i] - g) * sine + 2.0 * cosine * b
        p = sine * r
        diagonal[i + 1] = g + p
        g = cosine * r - b
        left, right = q[:, i].copy(), q[:, i + 1].copy()
        q[:, i + 1], q[:, i] = sine * left + cosine * right, cosine * left - sine * right
    diagonal[low] -= p
    beside[low] = g
    beside[high] = 0.0


def whole_numbers(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a list column, and their entries as whole numbers, one row each."""
    lists = column.cast(pa.list_(pa.float64()))
    lengths = np.asarray(lists.value_lengths().fill_null(-1))
    chosen = np.flatnonzero(lengths == dims)
    values = lists.take(pa.array(chosen)).flatten()
    c = values.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(chosen), dims)
    scaled = np.where(np.isfinite(c), c, LARGEST) * SCALE
    usable = (np.abs(scaled) < LARGEST).all(axis=1)
    return chosen[usable], np.floor(scaled[usable]).astype(np.int64) + OFFSET


def _rows(states: list[Moments], schema: pa.Schema) -> pa.RecordBatch:
    columns = [[s.n for s in states], [s.sums for s in states], [s.mean.tolist() for s in states]]
    columns.append([s.comoment.ravel().tolist() for s in states])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_ARROW_STATE = pa.schema(
    [
        ("n", pa.int64()),
        ("sums", pa.list_(pa.decimal128(38, 0))),
        ("mean", pa.list_(pa.float64())),
        ("comoment", pa.list_(pa.float64())),
    ]
)


def _state(row: dict, dims: int) -> Moments:
    return Moments(row["n"], [int(s) for s in row["sums"]], np.array(row["mean"]), np.array(row["comoment"]).reshape(dims, dims))


def _merge_batches(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Moments.zero(dims)
        for batch in batches:
            for row in batch.to_pylist():
                total = total.merge(_state(row, dims))
        if total.n:
            yield _rows([total], _ARROW_STATE)

    return run


def _merged(states: DataFrame, dims: int) -> Moments | None:
    """All states in one: merged in tasks until MERGERS are left, then here."""
    first = min(MERGERS * MERGERS, partitions(states.sparkSession))
    fewer = states.repartition(first).mapInArrow(_merge_batches(dims), _STATE)
    few = written(fewer.repartition(MERGERS).mapInArrow(_merge_batches(dims), _STATE), "moments")
    total = Moments.zero(dims)
    for row in few.collect():
        total = total.merge(_state(row.asDict(), dims))
    return total if total.n else None


@dataclass
class Whitening:
    """Axes fitted to a list of vectors; ``apply`` projects vectors on them."""

    dims: int
    moments: Moments
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def scales(self) -> np.ndarray:
        """One over the root of each component's eigenvalue; nan where the list does not vary along it."""
        floor = 1e-13 * max(self.trace, 0.0)
        return np.array([1.0 / np.sqrt(e) if e > floor else np.nan for e in self.values])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S in whole numbers: int64 where they fit, Python's integers elsewhere."""
        n, sums = self.moments.n, self.moments.sums
        if n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, sums), default=0) < 1 << 62:
            return n * x - np.array(sums, np.int64)
        return n * x.astype(object) - np.array(sums, object)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x).astype(np.float64) / self.moments.n) @ self.vectors * self.scales

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of n * x - S, exact; None beyond the range of a long."""
        centred = self.centred(x)
        if centred.dtype != object and int(np.abs(centred).max(initial=0)) ** 2 * max(self.dims, 1) < 1 << 63:
            return (centred * centred).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in centred]
        return [v if v < 1 << 63 else None for v in exact]


def dimensions(vectors: DataFrame, vector_col: str) -> int:
    """The commonest length of the vectors (the smaller of two as common); 0 without any."""
    lengths = vectors.select(F.size(F.col(f"`{vector_col}`")).alias("dims")).where("dims > 0").groupBy("dims").count()
    first = lengths.orderBy(F.desc("count"), "dims").first()
    return first["dims"] if first else 0


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = 8) -> Whitening | None:
    """Mean, covariance and the first axes of all usable vectors; None without any.

    A vector is usable if it has the commonest length and no entry that is null, nan, infinite or above 2**40 / 1024 in
    size. Repeated vectors count as often as they occur.
    """
    dims = dimensions(vectors, vector_col)
    if not dims:
        return None

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments.zero(dims)
        for batch in batches:
            _, x = whole_numbers(batch.column(0), dims)
            state.sums = [a + int(b) for a, b in zip(state.sums, x.sum(axis=0))]
            state.add(x.astype(np.float64))
        if state.n:
            yield _rows([state], _ARROW_STATE)

    moments = _merged(vectors.select(F.col(f"`{vector_col}`").alias("vector")).mapInArrow(gather, _STATE), dims)
    if moments is None:
        return None
    covariance = moments.covariance
    values, axes = symmetric_qr(covariance)
    return Whitening(dims, moments, values[:components], axes[:, :components], float(np.trace(covariance)))


def identity_error(vectors: DataFrame, model: Whitening, vector_col: str = "embedding") -> float | None:
    """The largest absolute entry of the projected vectors' covariance minus the identity, over all usable vectors.

    Components along which nothing varies are left out; None if none is left.
    """
    varying = np.flatnonzero(np.isfinite(model.scales))
    if not len(varying):
        return None
    k, dims = len(varying), model.dims

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Moments.zero(k)
        for batch in batches:
            _, x = whole_numbers(batch.column(0), dims)
            if len(x):
                state.add(model.project(x)[:, varying])
        if state.n:
            yield _rows([state], _ARROW_STATE)

    total = _merged(vectors.select(F.col(f"`{vector_col}`").alias("vector")).mapInArrow(gather, _STATE), k)
    return float(np.abs(total.covariance - np.eye(k)).max())


def whiten(vectors: DataFrame, vector_col: str = "embedding", components: int = 8, keep: list[str] | None = None) -> DataFrame:
    """A row for each usable vector (see fit) and component: the columns ``keep`` (all others by default), ``component``,
    ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    Null ids and other columns pass as they are; repeated rows give repeated rows; an empty table, or one without a
    usable vector, gives no row. ``whitened`` is null along a component in which the vectors do not vary (one row, or
    all rows alike), ``explained`` is null where nothing varies, ``identity_error`` where it has no component to cover.
    ``deviation`` is null beyond the range of a long. Kept columns named like new ones give way.
    """
    spark = vectors.sparkSession
    new = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    kept = [c for c in (vectors.columns if keep is None else keep) if c != vector_col and c not in new]
    packed = vectors.select(packed_row(kept), F.col(f"`{vector_col}`").alias("vector"))
    types = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors, vector_col, components)
    if model is None:
        nothing = ", ".join(f"CAST(NULL AS {t.split()[1]}) AS {t.split()[0]}" for t in types.split(", "))
        return packed.where("false").select(*unpacked(kept), *[F.expr(e) for e in nothing.split(", ")])
    error = identity_error(vectors, model, vector_col)
    k, dims, n = len(model.values), model.dims, model.moments.n
    explained = [float(e / model.trace) if model.trace > 0 else None for e in model.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, x = whole_numbers(batch.column(1), dims)
            if not len(x):
                continue
            rows = batch.column(0).take(pa.array(np.repeat(places, k)))
            projected = model.project(x).ravel()
            columns = [
                rows,
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * k, n, np.int64)),
                pa.array([v for v in model.deviations(x) for _ in range(k)], pa.int64()),
                pa.array(projected, mask=np.isnan(projected)),
                pa.array(explained * len(x), pa.float64()),
                pa.array([error] * (len(x) * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", *new])

    schema = packed.select("row").schema
    for field in spark.createDataFrame([], types).schema:
        schema = schema.add(field)
    return packed.mapInArrow(run, schema).select(*unpacked(kept), *[F.col(c) for c in new])
