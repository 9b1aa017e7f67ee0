"""Cross-validated logistic models: all folds, candidates and calibrators are fitted together, in the same scans.

Rows meet their folds once, in a written table. One scan then adds up, for each model that is not yet done, the loss,
gradient and Hessian of its training rows in the tasks' partitions; Newton steps are taken on the driver from these
sums, whose size depends on models and columns and not on rows. About eight scans fit any number of models.

Rows without a label of 0 or 1, or with a null or NaN input, take no part.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..deploy import ship
from ..functions.special import sigmoid
from ..plans.scratch import written
from ..plans.series import SLICE_NS
from . import metrics
from .scoring import LinearModel

#: Parts of a calibrated model's training rows: each is held back from one of its members.
PARTS = 3
#: The fold of the model fitted on all rows.
EVERY = -1
METRICS = ("auc", "brier", "brier_skill", "avg_precision", "log_loss")
_NO_PART = -1
_STEP, _SCANS = 1e-9, 60


@dataclass
class _Fit:
    """A model that is being fitted, by ridge-penalised logistic loss (the bias is the last coefficient, unpenalised).

    It learns from the training rows of ``fold`` outside ``part``, or, over the ``decision`` of another one, from those
    inside. ``targets`` are what labels 0 and 1 count as.
    """

    fold: int
    part: int
    columns: tuple[int, ...]
    mean: np.ndarray
    scale: np.ndarray
    penalty: float
    targets: tuple[float, float] = (0.0, 1.0)
    decision: _Fit | None = None
    at: np.ndarray = field(default_factory=lambda: np.zeros(0))
    step: np.ndarray = field(default_factory=lambda: np.zeros(0))
    loss: float = np.inf
    done: bool = False

    def rows(self, member: np.ndarray, part: np.ndarray) -> np.ndarray:
        own = member[:, self.fold]
        if self.part == _NO_PART:
            return own
        return own & ((part[:, self.fold] == self.part) == (self.decision is not None))

    def design(self, x: np.ndarray) -> np.ndarray:
        scaled = (x[:, self.columns] - self.mean) / self.scale
        if self.decision is not None:
            scaled = (self.decision.design(x) @ self.decision.at)[:, None]
        return np.hstack([scaled, np.ones((len(x), 1))])

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z, t = self.design(x), np.where(y == 1, self.targets[1], self.targets[0])
        raw = z @ (self.at + self.step)
        p = 0.5 * (1 + np.tanh(raw / 2))
        return np.concatenate([[np.sum(np.logaddexp(0, raw) - t * raw)], z.T @ (p - t), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])

    def advance(self, sums: np.ndarray) -> None:
        """Takes the step that ``sums`` were made for, or half of it where the loss went up."""
        now, size = self.at + self.step, len(self.at)
        ridge = np.append(np.full(size - 1, self.penalty), 0.0)
        loss = sums[0] + 0.5 * float(ridge @ now**2)
        if loss > self.loss + 1e-12 * abs(self.loss):
            self.step = self.step / 2
            self.done = bool(np.max(np.abs(self.step)) < _STEP)
            return
        gradient, hessian = sums[1 : size + 1] + ridge * now, sums[size + 1 :].reshape(size, size) + np.diag(ridge)
        self.at, self.loss = now, loss
        self.step = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        if np.max(np.abs(self.step)) < _STEP * max(1.0, float(np.max(np.abs(now)))):
            self.at, self.done = now + self.step, True


def examples(data: DataFrame, splits: DataFrame, columns: Sequence[str], label: str = "label", key: str = "fill_id", parts: bool = False, order: Sequence[str] = ("ts_ns",), slice_ns: int = SLICE_NS) -> DataFrame:
    """A written table of key, y, x (the columns as doubles), train and test (folds), and parts (along with train).

    Every row trains fold EVERY. With ``parts``, the training rows of a fold and class, by the columns ``order`` of
    ``data`` and the key, are PARTS runs of about equal size; the first of ``order`` is a time in nanoseconds.
    ``splits`` has fold (from 0), role and the key; the same key in a role of a fold twice counts once. Keys are unique
    in ``data``.
    """
    known = F.col(label).isin(0, 1)
    for c in columns:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    placed = {f"_o{i}": F.col(c) for i, c in enumerate(order)} if parts else {}
    rows = data.where(known).select(F.col(key).alias("key"), F.col(label).cast("double").alias("y"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), *[v.alias(k) for k, v in placed.items()])
    roles = splits.select("fold", "role", F.col(key).alias("key"))
    none = F.lit(_NO_PART)
    if parts:
        roles = roles.dropDuplicates(["fold", "role", "key"])
        timed = rows.select("key", "y", *placed)
        train = roles.where("role = 'train'").drop("role").join(timed, "key").unionByName(timed.withColumn("fold", F.lit(EVERY)))
        dealt = _parts(train, list(placed), slice_ns).select("fold", F.lit("train").alias("role"), "key", "part")
        roles = dealt.unionByName(roles.where("role = 'test'").select("fold", "role", "key", none.alias("part")))
    else:
        roles = roles.select("fold", "role", "key", none.alias("part"))
    # Sets of folds, not distinct rows: a key's folds come from one row and are put together before they are moved.
    of = roles.groupBy("key").agg(*[F.array_sort(F.collect_set(F.when(F.col("role") == r, F.struct("fold", "part")))).alias(r) for r in ("train", "test")])
    d = rows.join(of, "key", "left")
    nothing = F.array().cast("array<int>")
    pick = lambda role, c: F.coalesce(F.transform(role, lambda s: s[c].cast("int")), nothing)
    train, part = pick("train", "fold"), pick("train", "part")
    if not parts:
        train, part = F.concat(F.array(F.lit(EVERY)), train), F.concat(F.array(none), part)
    return written(d.select("key", "y", "x", train.alias("train"), part.alias("parts"), pick("test", "fold").alias("test")), "examples")


def _parts(train: DataFrame, order: Sequence[str], slice_ns: int) -> DataFrame:
    """``train`` with part: stratified runs, ranks being counted in slices of time."""
    d = train.withColumn("_slice", F.floor(F.col(order[0]) / slice_ns))
    counts = d.groupBy("fold", "y", "_slice").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("fold", "y").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("fold", "y", "_slice", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("fold", "y", "_slice").orderBy(*order, "key")) - 1
    d = d.withColumn("_own", own).join(before, ["fold", "y", "_slice"]).withColumn("_rank", F.col("_own") + F.col("_before"))
    # Classes are laid one after the other, the one that comes first in time first, and dealt round the parts.
    size = train.groupBy("fold").agg(F.count("*").alias("_all"), F.min_by("y", F.struct(*order, "key")).alias("_first"), F.sum("y").cast("long").alias("_pos"))
    d = d.join(F.broadcast(size), "fold")  # one row a fold
    lead = F.when(F.col("_first") == 1, F.col("_pos")).otherwise(F.col("_all") - F.col("_pos"))

    def share(i: int) -> Column:
        first = F.ceil((lead - i) / PARTS)
        return F.when(F.col("y") == F.col("_first"), first).otherwise(F.ceil((F.col("_all") - i) / PARTS) - first)

    part = F.when(F.col("_rank") < share(0), 0)
    for i in range(1, PARTS - 1):
        part = part.when(F.col("_rank") < sum((share(j) for j in range(1, i + 1)), share(0)), i)
    return d.withColumn("part", part.otherwise(PARTS - 1))


def _arrays(batch: pa.RecordBatch, width: int, folds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x, y, and for each row and fold (EVERY is the last) whether it trains it, and its part there."""
    n = batch.num_rows
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, width)
    train = batch.column("train")
    row = np.repeat(np.arange(n), train.value_lengths().to_numpy(zero_copy_only=False))
    fold = train.flatten().to_numpy(zero_copy_only=False)
    member, part = np.zeros((n, folds + 1), bool), np.full((n, folds + 1), _NO_PART)
    member[row, fold] = True
    part[row, fold] = batch.column("parts").flatten().to_numpy(zero_copy_only=False)
    return x, batch.column("y").to_numpy(zero_copy_only=False), member, part


def _scan(table: DataFrame, width: int, folds: int, work: list, size: list[int]) -> list[np.ndarray]:
    """Sums over all rows of what each of ``work`` (with rows() and sums()) gives for its rows."""
    ship(table.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(s) for s in size]
        for batch in batches:
            if batch.num_rows:
                x, y, member, part = _arrays(batch, width, folds)
                for i, w in enumerate(work):
                    chosen = w.rows(member, part)
                    if chosen.any():
                        total[i] += w.sums(x[chosen], y[chosen])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(work)), pa.int32()), pa.array([t.tolist() for t in total], pa.list_(pa.float64()))], names=["id", "sums"])

    partial = table.select("x", "y", "train", "parts").mapInArrow(run, "id int, sums array<double>")
    summed = partial.select("id", F.posexplode("sums").alias("place", "value")).groupBy("id", "place").agg(F.sum("value").alias("value"))
    out = [np.zeros(s) for s in size]
    for r in summed.collect():  # one number for each coefficient of a sum, whatever the rows
        out[r["id"]][r["place"]] = r["value"]
    return out


@dataclass(frozen=True)
class _Count:
    """n, positives and sums of the columns, or, given their means, of squared distances to these."""

    fold: int
    part: int
    held: bool = False
    mean: tuple[float, ...] | None = None

    def rows(self, member: np.ndarray, part: np.ndarray) -> np.ndarray:
        own = member[:, self.fold]
        return own if self.part == _NO_PART else own & ((part[:, self.fold] == self.part) == self.held)

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        values = x if self.mean is None else (x - np.array(self.mean)) ** 2
        return np.concatenate([[len(y), y.sum()], values.sum(axis=0)])


def _newton(table: DataFrame, width: int, folds: int, fits: list[_Fit]) -> None:
    for f in fits:
        inputs = 1 if f.decision is not None else len(f.columns)
        f.at, f.step = np.zeros(inputs + 1), np.zeros(inputs + 1)
    for _ in range(_SCANS):
        open_ = [f for f in fits if not f.done]
        if not open_:
            return
        sizes = [1 + len(f.at) + len(f.at) ** 2 for f in open_]
        for f, s in zip(open_, _scan(table, width, folds, open_, sizes), strict=True):
            f.advance(s)
    warnings.warn(f"{sum(not f.done for f in fits)} of {len(fits)} models had not settled after {_SCANS} scans", RuntimeWarning, stacklevel=2)


@dataclass
class Ensemble:
    """The mean probability of linear models, each with its own sigmoid; one without calibration is itself."""

    members: list[LinearModel]

    def score(self, rows: DataFrame, out: str = "score") -> DataFrame:
        """``rows`` with the probability; null where an input is."""
        p = sum((sigmoid(m.raw() * m.sigmoid_scale) for m in self.members[1:]), sigmoid(self.members[0].raw() * self.members[0].sigmoid_scale))
        return rows.withColumn(out, p / len(self.members))


@dataclass
class Fitted:
    """Models by (candidate, fold); fold EVERY is fitted on all rows. Folds that train on one class have none."""

    table: DataFrame
    columns: list[str]
    candidates: list[list[str]]
    folds: list[int]
    counts: dict[int, tuple[int, int]]
    models: dict[tuple[int, int], Ensemble]

    def scores(self) -> DataFrame:
        """key, candidate, fold, label, score of every test row of every fold that has a model."""
        spark, width = self.table.sparkSession, len(self.columns)
        rows = []
        for (candidate, fold), model in self.models.items():
            if fold == EVERY:
                continue
            members = []
            for m in model.members:
                mean, scale, weight = [0.0] * width, [1.0] * width, [0.0] * width
                for name, *values in zip(m.names, m.mean, m.scale, m.weights, strict=True):
                    i = self.columns.index(name)
                    mean[i], scale[i], weight[i] = (float(v) for v in values)
                members.append((mean, scale, weight, float(m.bias)))
            rows.append((candidate, fold, members))
        member = "array<struct<mean: array<double>, scale: array<double>, weight: array<double>, bias: double>>"
        models = spark.createDataFrame(rows, f"candidate int, fold int, members {member}")
        tested = self.table.select("key", F.col("y").cast("int").alias("label"), "x", F.explode("test").alias("fold"))
        d = tested.join(F.broadcast(models), "fold")  # a few rows a fold and candidate

        def raw(m: Column) -> Column:
            terms = F.transform("x", lambda v, i: (v - F.get(m["mean"], i)) / F.get(m["scale"], i) * F.get(m["weight"], i))
            return F.aggregate(terms, m["bias"], lambda a, b: a + b)

        p = F.aggregate("members", F.lit(0.0), lambda a, m: a + sigmoid(raw(m))) / F.size("members")
        return d.select("key", "candidate", "fold", "label", p.alias("score"))

    def fold_results(self, scores: DataFrame | None = None) -> DataFrame:
        """candidate, fold, n_train and the values of metrics.evaluate, a row for each fold; null where it has no model."""
        spark = self.table.sparkSession
        found = metrics.evaluate(self.scores() if scores is None else scores, by=("candidate", "fold"))
        plan = [(c, f, self.counts[f][0]) for c in range(len(self.candidates)) for f in self.folds]
        return spark.createDataFrame(plan, "candidate int, fold int, n_train long").join(found, ["candidate", "fold"], "left")


def fit(data: DataFrame, splits: DataFrame, candidates: Sequence[Sequence[str]], label: str = "label", key: str = "fill_id", c: float = 1.0, calibrate: bool = False, every: bool = True, table: DataFrame | None = None, columns: Sequence[str] | None = None, **options) -> Fitted:
    """Fits each candidate (a list of columns) on each fold, and on all rows where ``every``.

    Inputs are scaled by their training rows' mean and population deviation. ``c`` is the inverse of the ridge penalty.
    With ``calibrate`` a model is PARTS members, each fitted without one part and calibrated on it by a sigmoid whose
    targets are (positives + 1) / (positives + 2) and 1 / (negatives + 2). ``table`` (of examples(), with ``columns``)
    spares the join when the same rows are used again; ``options`` go to examples().
    """
    columns = list(dict.fromkeys(x for cand in candidates for x in cand)) if columns is None else list(columns)
    table = examples(data, splits, columns, label, key, calibrate, **options) if table is None else table
    folds = sorted(r[0] for r in splits.select("fold").distinct().collect())
    if not folds:
        raise ValueError("no folds")
    if folds[0] < 0:
        raise ValueError("folds are numbered from 0")
    width, top = len(columns), folds[-1] + 1
    parts = list(range(PARTS)) if calibrate else [_NO_PART]
    wanted = [*folds, EVERY]
    sets = [_Count(f, p) for f in wanted for p in dict.fromkeys([_NO_PART, *parts])]
    sets += [_Count(f, p, True) for f in wanted for p in parts if calibrate]
    first = _scan(table, width, top, sets, [width + 2] * len(sets))
    mean = {s: v[2:] / max(v[0], 1) for s, v in zip(sets, first, strict=True)}
    count = {s: (int(v[0]), int(v[1])) for s, v in zip(sets, first, strict=True)}
    spread = [_Count(s.fold, s.part, s.held, tuple(mean[s])) for s in sets if not s.held]
    second = _scan(table, width, top, spread, [width + 2] * len(spread))
    deviation = {(s.fold, s.part): np.sqrt(v[2:] / max(v[0], 1)) for s, v in zip(spread, second, strict=True)}

    def both(s: _Count) -> bool:
        return 0 < count[s][1] < count[s][0]

    ready = [f for f in wanted if (every or f != EVERY) and all(both(_Count(f, p)) for p in parts) and (not calibrate or all(both(_Count(f, p, True)) for p in parts))]
    fits: dict[tuple[int, int, int], _Fit] = {}
    for i, candidate in enumerate(candidates):
        at = tuple(columns.index(x) for x in candidate)
        for f in ready:
            for p in parts:
                own = _Count(f, p)
                scale = deviation[f, p][list(at)]
                fits[i, f, p] = _Fit(f, p, at, mean[own][list(at)], np.where(scale > 1e-15 * np.abs(mean[own][list(at)]), scale, 1.0), 1 / c)
    _newton(table, width, top, list(fits.values()))
    sigmoids: dict[tuple[int, int, int], _Fit] = {}
    if calibrate:
        for k, base in fits.items():
            n, pos = count[_Count(base.fold, base.part, True)]
            sigmoids[k] = _Fit(base.fold, base.part, base.columns, base.mean, base.scale, 0.0, (1 / (n - pos + 2), (pos + 1) / (pos + 2)), base)
        _newton(table, width, top, list(sigmoids.values()))

    def linear(k: tuple[int, int, int]) -> LinearModel:
        f, names = fits[k], list(candidates[k[0]])
        slope, shift = sigmoids[k].at if k in sigmoids else (1.0, 0.0)
        return LinearModel(names, f.mean.tolist(), f.scale.tolist(), (slope * f.at[:-1]).tolist(), float(slope * f.at[-1] + shift))

    models = {(i, f): Ensemble([linear((i, f, p)) for p in parts]) for i in range(len(candidates)) for f in ready}
    counts = {f: count[_Count(f, _NO_PART)] for f in wanted}
    return Fitted(table, columns, [list(x) for x in candidates], folds, counts, models)


@dataclass
class Validation:
    """folds: fold, n_train and metrics; scores: key, fold, label, score; overall: metrics of these; model: fitted on
    all rows (None where these are of one class)."""

    folds: DataFrame
    scores: DataFrame
    overall: DataFrame
    model: Ensemble | None


def cross_validate(data: DataFrame, splits: DataFrame, columns: Sequence[str], calibrate: bool = False, label: str = "label", key: str = "fill_id", c: float = 1.0, **options) -> Validation:
    """Out-of-fold scores and their metrics, and the model refitted on all rows. A row that tests several folds has as
    many scores."""
    fitted = fit(data, splits, [list(columns)], label, key, c, calibrate, **options)
    scores = written(fitted.scores(), "scores")
    return Validation(fitted.fold_results(scores).drop("candidate"), scores.drop("candidate").withColumnRenamed("key", key), metrics.evaluate(scores), fitted.models.get((0, EVERY)))


def univariate_scores(data: DataFrame, splits: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """feature, auc, brier_skill (means over folds) and auc_min of models of one column each, best Brier skill first."""
    fitted = fit(data, splits, [[x] for x in columns], every=False, **options)
    named = F.element_at(F.array(*[F.lit(x) for x in columns]), F.col("candidate") + 1)
    d = fitted.fold_results().groupBy("candidate").agg(F.avg("auc").alias("auc"), F.avg("brier_skill").alias("brier_skill"), F.min("auc").alias("auc_min"))
    return d.select(named.alias("feature"), "auc", "brier_skill", "auc_min").orderBy(F.desc_nulls_last("brier_skill"), "feature")


@dataclass
class Selection:
    """Chosen columns in order, the metric after each, and what is left."""

    selected: list[str]
    history: list[tuple[str, float]]
    dropped: list[str]


def forward_select(data: DataFrame, splits: DataFrame, columns: Sequence[str], most: int = 8, gain: float = 0.002, floor: float = 0.0, metric: str = "brier_skill", label: str = "label", key: str = "fill_id", c: float = 1.0, **options) -> Selection:
    """Adds the column with the best mean fold metric (the first of equals) until that is below ``floor`` or less than
    ``gain`` above the last. All candidates of a round are fitted together."""
    columns = list(columns)
    table = examples(data, splits, columns, label, key, **options)
    chosen: list[str] = []
    history: list[tuple[str, float]] = []
    while len(chosen) < min(most, len(columns)):
        left = [x for x in columns if x not in chosen]
        fitted = fit(data, splits, [[*chosen, x] for x in left], label, key, c, every=False, table=table, columns=columns)
        means = fitted.fold_results().groupBy("candidate").agg(F.avg(metric).alias("m")).where("m is not null").collect()  # one row a candidate
        if not means:
            break
        best = min(means, key=lambda r: (-r["m"], r["candidate"]))
        if best["m"] < floor or (history and best["m"] - history[-1][1] < gain):
            break
        chosen.append(left[best["candidate"]])
        history.append((chosen[-1], best["m"]))
    return Selection(chosen, history, [x for x in columns if x not in chosen])


def summarize(folds: DataFrame) -> DataFrame:
    """metric, mean, std, min and max over the folds, of each metric that ``folds`` has."""
    have = [m for m in METRICS if m in folds.columns]
    stats = [F.struct(F.lit(m).alias("metric"), F.avg(m).alias("mean"), F.stddev_samp(m).alias("std"), F.min(m).alias("min"), F.max(m).alias("max")) for m in have]
    return folds.agg(F.array(*stats).alias("_s")).select(F.inline("_s"))
