"""Scores of probabilities, profit by toxicity, and what a gate is worth."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles

#: Bins of scores in [0, 1]; what lies outside goes to the first or last.
SCORE_BINS = 65_536


def tied_counts(scored: DataFrame, score: str = "score", label: str = "label", weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row for each distinct score: n and pos (weighted), both summed over all lower scores, and both over all.

    Windows run within a bin of scores; a table of one row a bin (SCORE_BINS at most) carries the sums of lower bins.
    ``by`` keeps groups of rows apart; null values in these columns are left out.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    known = scored.where(F.col(score).isNotNull() & F.col(label).isin(0, 1))
    per = known.groupBy(*by, F.col(score).cast("double").alias("s")).agg(F.sum(w).alias("n"), F.sum(w * F.col(label)).alias("pos"))
    spot = F.least(F.greatest(F.col("s"), F.lit(0.0)), F.lit(1.0)) * SCORE_BINS
    per = per.withColumn("bin", F.floor(spot).cast("int"))
    lower, everything = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    bins = per.groupBy(*by, "bin").agg(F.sum("n").alias("bin_n"), F.sum("pos").alias("bin_pos"))
    bins = bins.select(
        *by,
        "bin",
        F.coalesce(F.sum("bin_n").over(lower), F.lit(0.0)).alias("before_n"),
        F.coalesce(F.sum("bin_pos").over(lower), F.lit(0.0)).alias("before_pos"),
        F.sum("bin_n").over(everything).alias("all_n"),
        F.sum("bin_pos").over(everything).alias("all_pos"),
    )
    inside = Window.partitionBy(*by, "bin").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = {f"{c}_below": F.col(f"before_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0.0)) for c in ("n", "pos")}
    return per.join(bins if by else F.broadcast(bins), [*by, "bin"]).withColumns(below).select(*by, "s", "n", "pos", "n_below", "pos_below", "all_n", "all_pos")


def evaluate(scored: DataFrame, score: str = "score", label: str = "label", weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row (with ``by``, one for each group): n, base_rate, auc, avg_precision, brier, log_loss, brier_baseline, brier_skill.

    Ties share their rank in auc and their threshold in avg_precision. With one class alone all but n and base_rate are
    null. n is a count (long) unless rows are weighted.
    """
    t = tied_counts(scored, score, label, weight, by)
    neg, neg_below = F.col("n") - F.col("pos"), F.col("n_below") - F.col("pos_below")
    at_least_pos, at_least = F.col("all_pos") - F.col("pos_below"), F.col("all_n") - F.col("n_below")
    p = F.least(F.greatest(F.col("s"), F.lit(1e-9)), F.lit(1 - 1e-9))
    square = F.col("pos") * (F.col("s") - 1) * (F.col("s") - 1) + neg * F.col("s") * F.col("s")
    d = t.groupBy(*by).agg(
        F.coalesce(F.max("all_n"), F.lit(0.0)).alias("n"),
        F.max(F.col("all_pos") / F.col("all_n")).alias("base_rate"),
        F.sum(F.col("pos") * (neg_below + neg / 2)).alias("_won"),
        F.max(F.col("all_pos") * (F.col("all_n") - F.col("all_pos"))).alias("_pairs"),
        (F.sum(F.col("pos") * at_least_pos / at_least) / F.nullif(F.max("all_pos"), F.lit(0.0))).alias("_ap"),
        (F.sum(square) / F.max("all_n")).alias("_brier"),
        (-F.sum(F.col("pos") * F.log(p) + neg * F.log(1 - p)) / F.max("all_n")).alias("_log_loss"),
    )
    base = F.col("base_rate") * (1 - F.col("base_rate"))
    values = {
        "auc": F.col("_won") / F.col("_pairs"),
        "avg_precision": F.col("_ap"),
        "brier": F.col("_brier"),
        "log_loss": F.col("_log_loss"),
        "brier_baseline": base,
        "brier_skill": 1 - F.col("_brier") / base,
    }
    n = F.col("n") if weight else F.col("n").cast("long")
    return d.select(*by, n.alias("n"), "base_rate", *[F.when(F.col("_pairs") > 0, v).alias(k) for k, v in values.items()])


def quantile_bins(df: DataFrame, column: str, bins: int, out: str = "bin") -> DataFrame:
    """``df`` with the column's quantile bin, from 0: linear quantile edges, equal edges merged, bins closed on the right."""
    found = quantiles(df, column, [i / bins for i in range(bins + 1)])
    edges = F.lit(sorted({e for e in found if e is not None})).cast("array<double>")
    at = F.greatest(F.size(F.filter(edges, lambda e: e < F.col(column))) - 1, F.lit(0))
    return df.withColumn(out, F.when(F.col(column).isNotNull(), at))


def reliability(scored: DataFrame, score: str = "score", label: str = "label", bins: int = 10) -> DataFrame:
    """bin, n, mean_predicted, frac_positive, calibration_error."""
    d = quantile_bins(scored.where(F.col(score).isNotNull()), score, bins)
    d = d.groupBy("bin").agg(F.count("*").alias("n"), F.avg(score).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("frac_positive"))
    return d.withColumn("calibration_error", F.abs(F.col("mean_predicted") - F.col("frac_positive")))


def pnl_deciles(scored: DataFrame, score: str, pnl: str, bins: int = 10) -> DataFrame:
    """decile, n, mean_proba, mean_pnl, total_pnl, pnl_std, cumulative_pnl."""
    d = quantile_bins(scored.where(F.col(score).isNotNull() & F.col(pnl).isNotNull()), score, bins, "decile")
    d = d.groupBy("decile").agg(F.count("*").alias("n"), F.avg(score).alias("mean_proba"), F.avg(pnl).alias("mean_pnl"), F.sum(pnl).alias("total_pnl"), F.stddev_samp(pnl).alias("pnl_std"))
    return d.withColumn("cumulative_pnl", F.sum("total_pnl").over(Window.orderBy("decile")))  # one row a bin


def _average_rank(column: str) -> Column:
    same = Window.partitionBy(column)
    return F.rank().over(Window.orderBy(column)) + (F.count("*").over(same) - 1) / 2


def spearman(table: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rho, null with fewer than 3 rows. For short tables such as deciles: ranks need one window."""
    d = table.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(_average_rank(a).alias("ra"), _average_rank(b).alias("rb"))
    return d.agg(F.when(F.count("*") >= 3, F.corr("ra", "rb")).alias("rho"))


def gate_sweep(scored: DataFrame, score: str, pnl: str, thresholds: Sequence[float] | None = None, spread_cost: float = 0.0) -> DataFrame:
    """One row a threshold: what blocking fills with a score of at least that would have changed."""
    thresholds = [float(x) for x in (np.round(np.arange(0.5, 0.96, 0.05), 10) if thresholds is None else thresholds)]
    d = scored.where(F.col(score).isNotNull() & F.col(pnl).isNotNull()).select(F.col(score).alias("p"), F.col(pnl).alias("x"), F.explode(F.lit(thresholds)).alias("threshold"))
    blocked = F.col("p") >= F.col("threshold")
    d = d.groupBy("threshold").agg(
        F.count("*").alias("n_fills"),
        F.count_if(blocked).alias("n_blocked"),
        F.sum("x").alias("pnl_ungated"),
        F.coalesce(F.sum(F.when(~blocked, F.col("x"))), F.lit(0.0)).alias("_kept"),
        F.avg(F.when(blocked, F.col("x"))).alias("mean_pnl_blocked"),
        F.avg(F.when(~blocked, F.col("x"))).alias("mean_pnl_kept"),
        (spread_cost * F.count_if(blocked & (F.col("x") > 0))).cast("double").alias("opportunity_cost"),
    )
    gated = F.col("_kept") - F.col("opportunity_cost")
    return d.select("threshold", "n_fills", "n_blocked", (F.col("n_blocked") / F.col("n_fills")).alias("blocked_share"), "pnl_ungated", gated.alias("pnl_gated"), (gated - F.col("pnl_ungated")).alias("pnl_improvement"), "mean_pnl_blocked", "mean_pnl_kept", "opportunity_cost")


def choose_threshold(sweep: DataFrame) -> float | None:
    """The threshold of the largest improvement, if that is above 0."""
    row = sweep.orderBy(F.desc("pnl_improvement"), "threshold").first()
    return row["threshold"] if row and row["pnl_improvement"] > 0 else None


def alpha_drift(history: DataFrame, value: str = "alpha_mu", order: str = "t", window: int = 20, z: float = 2.0) -> DataFrame:
    """``history`` with rolling_mean, zscore and drifted over the last ``window`` rows, from the fifth on."""
    w = Window.orderBy(order).rowsBetween(-(window - 1), 0)
    enough = F.count(value).over(w) >= 5
    d = history.withColumns({"rolling_mean": F.when(enough, F.avg(value).over(w)), "_std": F.when(enough, F.nullif(F.stddev_samp(value).over(w), F.lit(0.0)))})
    d = d.withColumn("zscore", (F.col(value) - F.col("rolling_mean")) / F.col("_std")).drop("_std")
    return d.withColumn("drifted", F.coalesce(F.abs("zscore") > z, F.lit(False)))


def drift_report(scored: DataFrame, reference: dict | None = None, score: str = "score", label: str = "label", bins: int = 10) -> DataFrame:
    """One row: evaluate()'s values, max_calibration_error over the bins of reliability(), and for each of auc, brier and
    brier_skill that ``reference`` holds the difference to it, delta_auc and so on."""
    known = scored.where(F.col(label).isin(0, 1))
    worst = reliability(known, score, label, bins).agg(F.max("calibration_error").alias("max_calibration_error"))
    row = evaluate(known, score, label).crossJoin(worst)  # a row each
    return row.withColumns({f"delta_{k}": F.col(k) - v for k, v in (reference or {}).items() if k in ("auc", "brier", "brier_skill")})


def should_retrain(folds: DataFrame, auc_floor: float = 0.55, skill_floor: float = 0.02, lookback: int = 3) -> dict:
    """Whether the last folds' mean auc or Brier skill is below its floor; without folds, yes."""
    recent = folds.orderBy(F.desc("fold")).limit(lookback).agg(F.avg("auc").alias("auc"), F.avg("brier_skill").alias("skill"), F.count("*").alias("n")).first()
    if not recent["n"]:
        return {"retrain": True, "reason": "no folds"}
    reasons = [f"{name} {value:.3f} is below {floor}" for name, value, floor in (("auc", recent["auc"], auc_floor), ("Brier skill", recent["skill"], skill_floor)) if value is not None and value < floor]
    return {"retrain": bool(reasons), "reason": "; ".join(reasons) or "within tolerance", "recent_auc": recent["auc"], "recent_brier_skill": recent["skill"]}
