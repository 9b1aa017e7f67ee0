"""One call from ticks and fills to a verdict on the flow: analyse() runs the operators in order and judges the result
on fills that took no part in any choice.

Ticks, fills, readings and the matrix of features are written once and read from there. What comes to the driver are
settings and results of a few rows: volumes, thresholds, coefficients, metrics.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import cleaning, features, folds, gate, holdout, labels, markouts, metrics, splits, vpin
from .plans.scratch import written
from .plans.series import SLICE_NS

#: Readings below which nothing is judged, and fills below which a counterparty isn't listed.
LEAST_READINGS, LEAST_FILLS = 10, 20
#: Thresholds that a gate is chosen from.
CUTS = tuple(i / 20 for i in range(1, 20))
#: (losing, separates, pays) to verdict and status; fixed values.
VERDICTS = {
    (True, True, True): ("LOSING TO TOXIC FLOW", "critical"),
    (True, True, False): ("LOSING TO TOXIC FLOW", "critical"),
    (True, False, True): ("LOSING TO TOXIC FLOW", "critical"),
    (True, False, False): ("LOSING MONEY (no toxic subset found)", "critical"),
    (False, True, True): ("PROFITABLE, TOXIC SUBSET", "warning"),
    (False, True, False): ("PROFITABLE, WEAK TOXIC SIGNAL", "warning"),
    (False, False, True): ("PROFITABLE, WEAK TOXIC SIGNAL", "warning"),
    (False, False, False): ("BENIGN", "good"),
}


@dataclass
class Settings:
    """What analyse() does. ``bucket_volume`` None takes the suggested one; ``label_threshold`` is markout_threshold's;
    other rules take ``vol_multiple`` times the median move of the label horizon."""

    horizons: Sequence[float] = (1.0, 5.0, 30.0, 300.0, 1800.0)
    label_horizon: float = 300.0
    label_rule: str = "triple_barrier"
    label_threshold: float = 0.0
    vol_multiple: float = 1.0
    bucket_volume: float | None = None
    buckets_per_day: int = 50
    vpin_window: int = 50
    short_seconds: float = features.SHORT
    long_seconds: float = features.LONG
    columns: Sequence[str] = features.ALL
    select: bool = True
    calibrate: bool = False
    holdout: float = 0.25
    folds: int = 4
    pip: float = 1e-4
    slice_ns: int = SLICE_NS


@dataclass
class Analysis:
    """The tables and models behind a summary. ``summary`` is one row; ``tested`` are the held-out fills with score."""

    summary: DataFrame
    ticks: DataFrame
    readings: DataFrame
    matrix: DataFrame
    markout_summary: DataFrame
    curve: dict
    label_report: DataFrame
    single: DataFrame
    selection: folds.Selection | None
    validation: folds.Validation
    threshold: float | None
    tested: DataFrame
    baselines: DataFrame
    deciles: DataFrame
    sweep: DataFrame
    worst: DataFrame
    gate: DataFrame
    model: folds.Ensemble


def _one(df: DataFrame) -> dict:
    row = df.first()
    return row.asDict() if row else {}


def _labelled(marked: DataFrame, ticks: DataFrame, s: Settings, theta: float) -> DataFrame:
    if s.label_rule == "markout_threshold":
        nearest = min(s.horizons, key=lambda h: abs(h - s.label_horizon))
        return labels.label(marked, ticks, s.label_rule, nearest, theta, slice_ns=s.slice_ns)
    return labels.label(marked, ticks, s.label_rule, s.label_horizon, theta, min_adverse=theta, slice_ns=s.slice_ns)


def _matrix(labelled: DataFrame, ticks: DataFrame, readings: DataFrame, s: Settings, name: str) -> DataFrame:
    d = features.build_features(labels.drop_undecidable(labelled), ticks, readings, s.short_seconds, s.long_seconds, s.label_horizon, slice_ns=s.slice_ns)
    return written(features.select_matrix(d, s.columns), name)


def _drawn_anew(label: str, rate: float) -> Column:
    """Decided labels drawn again at their rate, from a hash of the fill: nothing can foretell them."""
    u = F.pmod(F.xxhash64(F.lit("shuffled"), "fill_id"), F.lit(1_000_000)) / 1e6
    return F.when(F.col(label) >= 0, (u < rate).cast("int")).otherwise(F.col(label))


def analyse(ticks: DataFrame, fills: DataFrame, settings: Settings | None = None) -> Analysis:
    """Cleans ticks, reads VPIN, marks out and labels fills, builds features, picks columns and a gate's threshold on
    the earlier fills by walk-forward folds, and scores model and gate once on the later ones.

    ``ticks`` has seq, ts_ns, bid, ask, mid, spread, volume and sizes; ``fills`` fill_id (unique), seq, ts_ns, sign,
    price, size and counterparty_id. Raises ValueError where there are too few readings, no fill with a known label and
    all features, one class alone to learn from, or too few fills to split.
    """
    s = settings or Settings()
    ticks = written(cleaning.clean_ticks(ticks)[0], "ticks")
    volume = s.bucket_volume or (vpin.suggest_bucket_volume(ticks, s.buckets_per_day, s.vpin_window).first()["bucket_volume"] or 0.0)
    if not volume > 0:
        raise ValueError("ticks without volume")
    readings = written(vpin.vpin(ticks, volume, s.vpin_window, dist="student_t", slice_ns=s.slice_ns), "readings")
    if readings.where("vpin IS NOT NULL").count() < LEAST_READINGS:
        raise ValueError("too few VPIN readings: a smaller bucket volume or window is needed")

    marked = written(markouts.markouts(fills, ticks, s.horizons, slice_ns=s.slice_ns), "marked")
    curve = markouts.fit_curve(marked, s.horizons)
    theta = s.label_threshold if s.label_rule == "markout_threshold" else labels.suggest_theta(ticks, s.label_horizon, s.vol_multiple).first()["theta"]
    if theta is None:
        raise ValueError(f"no window of {s.label_horizon} s fits inside the ticks")
    labelled = written(_labelled(marked, ticks, s, theta), "labelled")
    matrix = _matrix(labelled, ticks, readings, s, "matrix")
    if matrix.isEmpty():
        raise ValueError("no fill has a known label and all features")

    role = splits.holdout(matrix.select("fill_id", "ts_ns", "seq"), s.label_horizon, s.holdout).select("fill_id", "role")
    parted = written(matrix.join(role, "fill_id"), "parted")
    dev, test = parted.where("role = 'dev'"), parted.where("role = 'test'")
    plan = written(splits.walk_forward(dev.select("fill_id", "ts_ns", "seq"), s.label_horizon, s.folds), "plan")
    splits.assert_no_leakage(plan, s.label_horizon)
    columns = list(s.columns)
    single = folds.univariate_scores(dev, plan, columns)
    selection = folds.forward_select(dev, plan, columns) if s.select else None
    if selection and selection.selected:
        columns = selection.selected
    options = {"slice_ns": s.slice_ns} if s.calibrate else {}
    validation = folds.cross_validate(dev, plan, columns, s.calibrate, **options)
    model = validation.model
    if model is None:
        raise ValueError("the fills to learn from have one label alone")

    pnl = markouts.nearest_column(s.horizons, s.label_horizon)
    threshold = metrics.choose_threshold(metrics.gate_sweep(validation.scores.select("fill_id", "score").join(dev.select("fill_id", pnl), "fill_id"), "score", pnl, CUTS))

    tested = written(model.score(test, "score").withColumn("hour", holdout.hour_blocks()), "tested")
    held = _one(holdout.holdout_scores(tested, "hour"))
    own = _one(metrics.evaluate(model.score(dev, "score")))
    gated = _one(holdout.gate_scores(tested, threshold, "hour", pnl=pnl)) if threshold is not None else None
    base = dev.agg(F.avg("label")).first()[0]
    # Features hold counterparty history, which is made again from the new labels.
    anew = _matrix(labelled.withColumn("label", _drawn_anew("label", base)), ticks, readings, s, "anew").join(role, "fill_id")
    blind = folds.fit(anew.where("role = 'dev'"), plan, [columns], calibrate=s.calibrate, **options).models.get((0, folds.EVERY))
    chance = _one(metrics.evaluate(blind.score(anew.where("role = 'test'"), "score")))["auc"] if blind else None

    several = [("base rate", F.lit(base)), ("model", F.col("score"))]
    if "cp_toxic_rate_hist" in s.columns:
        several.insert(1, ("counterparty history", F.col("cp_toxic_rate_hist")))
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), v.cast("double").alias("score")) for n, v in several])).alias("_b")
    baselines = metrics.evaluate(tested.select(long, "label").select("_b.model", "_b.score", "label"), by=("model",)).select("model", "auc", "brier_skill", "log_loss")
    deciles = written(metrics.pnl_deciles(tested, "score", pnl), "deciles")
    rho = metrics.spearman(deciles, "mean_proba", "mean_pnl").first()[0]
    sweep = metrics.gate_sweep(tested, "score", pnl, CUTS)
    config = gate.GateConfig(alpha_mu=curve["alpha_mu"], **({"widen_above": threshold, "suspend_above": threshold, "tighten_below": 0.0} if threshold is not None else {}))
    actions = gate.summary(gate.simulate(tested.withColumnsRenamed({"score": "proba", "spread": "base_spread"}), "counterparty_id", config))

    worst = matrix.groupBy("counterparty_id").agg(F.avg(pnl).alias("mean_markout"), F.count("*").alias("n_fills")).where(F.col("n_fills") >= LEAST_FILLS)
    worst = worst.orderBy("mean_markout", "counterparty_id").limit(5)

    problems = []
    if held["auc_low"] is None or not held["auc_low"] > 0.5:
        problems.append("the holdout's area under the curve is not distinguishable from chance")
    if None not in (own["auc"], held["auc"]) and own["auc"] - held["auc"] > 0.05:
        problems.append(f"the area under the curve falls by {own['auc'] - held['auc']:.3f} from the fitted fills to the holdout")
    if chance is not None and chance > 0.55:
        problems.append(f"labels drawn anew are still foretold: {chance:.3f}")
    if gated is not None and (gated["uplift_low"] is None or not gated["uplift_low"] > 0):
        problems.append("the gate's gain on the holdout is not significant")

    short, long_ = s.horizons[0], s.horizons[-1]
    keep = s.label_horizon if s.label_horizon > short else next((h for h in s.horizons if h >= 30), long_)
    keep = keep if keep in s.horizons else long_
    sums = matrix.agg(
        F.count("*").alias("n_fills"),
        F.min("ts_ns").alias("start_ns"),
        F.max("ts_ns").alias("end_ns"),
        F.avg("label").alias("toxic_rate"),
        (F.avg(markouts.column(short)) / s.pip).alias("spread_earned_pips"),
        (F.avg(markouts.column(keep)) / s.pip).alias("net_edge_pips"),
    ).first()
    cost = markouts.spread_vs_adverse_selection(marked, curve)
    pays = gated is not None and (gated["uplift"] or 0.0) > 0.05
    separates = (held["brier_skill"] or 0.0) > 0 and rho is not None and rho < -0.3
    verdict, status = VERDICTS[(sums["net_edge_pips"] or 0.0) < 0, separates, pays]
    used = gated if gated is not None and (gated["uplift"] or 0.0) > 0 else {}
    percent = lambda k: 100 * used[k] if used.get(k) is not None else None
    row = {
        **sums.asDict(),
        "n_ticks": ticks.count(),
        "bucket_volume": float(volume),
        "theta": float(theta),
        "adverse_pips": None if None in (sums["spread_earned_pips"], sums["net_edge_pips"]) else sums["spread_earned_pips"] - sums["net_edge_pips"],
        "alpha_mu_pips": cost["adverse_selection"] / s.pip,
        "alpha_identified": bool(curve["identified"]),
        **{k: held[k] for k in ("auc", "auc_low", "auc_high", "brier_skill", "brier_skill_low", "brier_skill_high")},
        "auc_fitted": own["auc"],
        "auc_out_of_fold": _one(validation.overall)["auc"],
        "auc_labels_anew": chance,
        "monotonicity": rho,
        "gate_threshold": used.get("threshold"),
        "gate_blocked_share": used.get("blocked_share"),
        "gate_uplift_pct": percent("uplift"),
        "gate_uplift_low_pct": percent("uplift_low"),
        "gate_uplift_high_pct": percent("uplift_high"),
        "features": columns,
        "problems": problems,
        "verdict": verdict,
        "status": status,
    }
    spark = ticks.sparkSession
    schema = ", ".join(f"{k} {_TYPES.get(k, 'double')}" for k in row)
    return Analysis(
        spark.createDataFrame([tuple(row.values())], schema), ticks, readings, matrix, markouts.summary(marked, s.horizons), curve, labels.report(labelled), single, selection,
        validation, threshold, tested, baselines, deciles, sweep, worst, actions, model,
    )


_TYPES = {
    "n_fills": "long",
    "start_ns": "long",
    "end_ns": "long",
    "n_ticks": "long",
    "alpha_identified": "boolean",
    "features": "array<string>",
    "problems": "array<string>",
    "verdict": "string",
    "status": "string",
}


@dataclass
class _Text:
    lines: list[str] = field(default_factory=list)

    def add(self, name: str, value: str) -> None:
        self.lines.append(f"  {name:<22}{value}")


def text(found: Analysis) -> str:
    """The summary for reading."""
    r = _one(found.summary)
    time = lambda ns: datetime.datetime.fromtimestamp(ns / 1e9, datetime.timezone.utc).strftime("%Y-%m-%d %H:%M")
    show = lambda v, form: "-" if v is None else format(v, form)
    t = _Text([f"{r['verdict']} ({r['status']})"])
    t.add("fills, ticks", f"{r['n_fills']:,}, {r['n_ticks']:,}; {time(r['start_ns'])} to {time(r['end_ns'])}")
    t.add("toxic rate", show(r["toxic_rate"], ".1%"))
    t.add("spread earned, pips", show(r["spread_earned_pips"], "+.3f"))
    t.add("adverse move, pips", show(r["adverse_pips"], "+.3f"))
    t.add("net edge, pips", show(r["net_edge_pips"], "+.3f"))
    t.add("area under the curve", f"{show(r['auc'], '.3f')} [{show(r['auc_low'], '.3f')}, {show(r['auc_high'], '.3f')}]")
    t.add("Brier skill", show(r["brier_skill"], "+.4f"))
    t.add("monotonicity", show(r["monotonicity"], "+.3f"))
    if r["gate_threshold"] is not None:
        t.add("gate", f"block at {r['gate_threshold']:.2f}: {r['gate_blocked_share']:.1%} of fills, {r['gate_uplift_pct']:+.1f} %")
    t.add("features", ", ".join(r["features"]))
    for c in found.worst.collect():  # five rows at most
        t.add(f"  {c['counterparty_id']}", f"{c['mean_markout']:+.2e} over {c['n_fills']:,} fills")
    t.lines += [f"  !! {p}" for p in r["problems"]]
    return "\n".join(t.lines)
