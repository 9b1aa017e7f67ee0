"""Markouts of fills, their curve and what they cost."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.series import SLICE_NS, asof, seconds

HORIZONS = (1, 5, 30, 300, 1800)


def column(horizon: float) -> str:
    return f"markout_{int(horizon) if float(horizon).is_integer() else horizon}s"


def nearest_column(horizons: Sequence[float], wanted: float) -> str:
    return column(min(horizons, key=lambda h: abs(h - wanted)))


def markouts(fills: DataFrame, ticks: DataFrame, horizons: Sequence[float] = HORIZONS, by: Sequence[str] = (), slice_ns: int = SLICE_NS) -> DataFrame:
    """``fills`` with mid_at_fill, effective_half_spread and a markout for each horizon.

    A markout is sign * (price - mid at t + horizon), positive when the liquidity provider earns; null where no tick
    has come before the fill, or the series ends before t + horizon. All horizons share one as-of pass.
    """
    key = [*by, "fill_id"]
    last = ticks.groupBy(*by).agg(F.max("ts_ns").alias("_end"))
    shifts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(seconds(h)).alias("by_ns")) for i, h in enumerate([0, *horizons])])
    probes = fills.select(*key, "ts_ns", F.explode(shifts).alias("s")).select(*key, F.col("s.i").alias("i"), (F.col("ts_ns") + F.col("s.by_ns")).alias("target"))
    found = asof(probes, ticks, ["mid"], by, slice_ns, at="target")
    found = found.join(last, list(by)) if by else found.crossJoin(F.broadcast(last))
    found = found.withColumn("mid", F.when((F.col("i") == 0) | (F.col("target") <= F.col("_end")), F.col("mid")))
    wide = found.groupBy(*key).agg(*[F.max(F.when(F.col("i") == i, F.col("mid"))).alias(f"_m{i}") for i in range(len(horizons) + 1)])
    out = fills.join(wide, key, "left")
    out = out.withColumns({"mid_at_fill": F.col("_m0"), "effective_half_spread": F.col("sign") * (F.col("price") - F.col("_m0"))})
    out = out.withColumns({column(h): F.col("sign") * (F.col("price") - F.col(f"_m{i + 1}")) for i, h in enumerate(horizons)})
    return out.drop(*[f"_m{i}" for i in range(len(horizons) + 1)])


def summary(marked: DataFrame, horizons: Sequence[float] = HORIZONS, by: str | None = None) -> DataFrame:
    """horizon_seconds, mean_markout, n_observed; or with ``by`` the group's means and n_fills."""
    if by:
        return marked.groupBy(by).agg(F.count("*").alias("n_fills"), *[F.avg(column(h)).alias(column(h)) for h in horizons])
    long = F.explode(F.array(*[F.struct(F.lit(float(h)).alias("h"), F.col(column(h)).alias("m")) for h in horizons]))
    return marked.select(long.alias("x")).groupBy(F.col("x.h").alias("horizon_seconds")).agg(F.avg("x.m").alias("mean_markout"), F.count("x.m").alias("n_observed"))


def curve(half_spread: float, alpha: float, rate: float, tau: Column) -> Column:
    return F.lit(half_spread) - F.lit(alpha) * (1 - F.exp(-F.lit(rate) * tau))


def fit_curve(marked: DataFrame, horizons: Sequence[float] = HORIZONS, weighted: bool = True) -> dict:
    """Fits half_spread - alpha * (1 - exp(-rate * tau)) to the mean markouts; alpha >= 0, rate in [1e-6, 10].

    Spark adds up a count, mean and deviation for each horizon; the fit over these few numbers is linear but for the
    rate, which is searched. ``identified`` says whether the profile tells alpha from the rate.
    """
    row = marked.agg(*[f(column(h)).alias(f"{n}_{i}") for i, h in enumerate(horizons) for n, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_samp))]).first()
    used = [(float(h), row[f"mean_{i}"], row[f"n_{i}"], row[f"sd_{i}"] / math.sqrt(row[f"n_{i}"])) for i, h in enumerate(horizons) if row[f"n_{i}"] >= 2]
    if len(used) < 3:
        raise ValueError("the fit needs at least 3 horizons with two markouts or more")
    tau, mean, n, sem = (np.array(x, float) for x in zip(*used, strict=True))
    weight = 1 / sem if weighted and (sem > 0).all() else np.ones_like(tau)

    def at(rate: float) -> tuple[float, np.ndarray]:
        rise = 1 - np.exp(-rate * tau)
        a = np.column_stack([np.ones_like(tau), -rise]) * weight[:, None]
        p, *_ = np.linalg.lstsq(a, mean * weight, rcond=None)
        if p[1] < 0:
            p = np.array([(mean * weight**2).sum() / (weight**2).sum(), 0.0])
        return float((((p[0] - p[1] * rise - mean) * weight) ** 2).sum()), p

    grid = np.linspace(math.log(1e-6), math.log(10), 400)
    best = int(np.argmin([at(math.exp(g))[0] for g in grid]))
    low, high = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]
    for _ in range(80):  # golden section within the best cells
        a, b = high - 0.6180339887498949 * (high - low), low + 0.6180339887498949 * (high - low)
        low, high = (low, b) if at(math.exp(a))[0] <= at(math.exp(b))[0] else (a, high)
    rate = math.exp((low + high) / 2)
    cost, (half, alpha) = at(rate)
    fade = np.exp(-rate * tau)
    jacobian = np.column_stack([np.ones_like(tau), -(1 - fade), -alpha * tau * fade]) * weight[:, None]
    errors = np.full(3, np.inf)
    _, s, vt = np.linalg.svd(jacobian, full_matrices=False)
    live = s > np.finfo(float).eps * max(jacobian.shape) * s[0]
    cov = (vt[live].T / s[live] ** 2) @ vt[live]
    if not weighted or not (sem > 0).all():
        cov = cov * cost / (len(tau) - 3) if len(tau) > 3 else np.full((3, 3), np.inf)
    errors = np.sqrt(np.diag(cov))
    at_bound = rate <= 1.01e-6 or rate >= 9.9
    loose = not np.isfinite(errors[1]) or errors[1] > abs(alpha)
    reason = "rate at its bound: the profile is too flat" if at_bound else "alpha's standard error exceeds it" if loose else None
    return {
        "half_spread": float(half), "alpha_mu": float(alpha), "lambda": rate, "breakeven_spread": 2 * float(alpha), "half_life_seconds": math.log(2) / rate,
        "stderr": dict(zip(("half_spread", "alpha_mu", "lambda"), map(float, errors), strict=True)), "identified": reason is None, "unidentified_reason": reason,
        "empirical_decay": float(mean[0] - mean[-1]), "taus": tau.tolist(), "empirical_means": mean.tolist(), "counts": n.astype(int).tolist(),
    }


def spread_vs_adverse_selection(marked: DataFrame, fit: dict) -> dict:
    """Realised half-spread against adverse selection: the fitted alpha, or the observed decay where that is unidentified."""
    half = marked.agg(F.avg("effective_half_spread")).first()[0]
    cost = fit["alpha_mu"] if fit["identified"] else max(fit["empirical_decay"], 0.0)
    return {"mean_half_spread": half, "adverse_selection": cost, "net_edge": half - cost, "profitable": half > cost}
