"""The quoting gate: hysteresis and dwell, one state machine for batch and streaming, and gating of signals."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from ..plans.series import seconds

ACTIONS = ("tighten", "normal", "widen", "suspend")
OUTPUT = "action string, multiplier double, spread double, changed boolean"


@dataclass(frozen=True)
class GateConfig:
    tighten_below: float = 0.35
    widen_above: float = 0.65
    suspend_above: float = 0.85
    hysteresis: float = 0.05
    min_dwell_seconds: float = 1.0
    tighten_factor: float = 0.9
    max_widen_factor: float = 5.0
    widen_factor: float = 2.5
    alpha_mu: float = 0.0

    @classmethod
    def of(cls, **values: float) -> GateConfig:
        known = {f.name for f in fields(cls)}
        if odd := set(values) - known:
            raise TypeError(f"unknown gate fields: {sorted(odd)}")
        return cls(**values)


@dataclass
class RiskGate:
    """``state`` and ``since`` are all that must be kept between updates."""

    config: GateConfig
    state: int = 1
    since: int | None = None

    def target(self, p: float) -> int:
        c = self.config
        if self.state == 3 and p > c.suspend_above - c.hysteresis or p >= c.suspend_above:
            return 3
        if self.state == 2 and p > c.widen_above - c.hysteresis or p >= c.widen_above:
            return 2
        return 0 if p <= c.tighten_below else 1

    def update(self, ts_ns: int, proba: float | None, base_spread: float) -> tuple[str, float, float, bool]:
        """(action, multiplier, spread, changed). Steps up are immediate, steps down wait for the dwell since the last change."""
        p = 0.5 if proba is None or math.isnan(proba) else min(max(proba, 0.0), 1.0)
        wanted, started = self.target(p), self.since is not None
        if wanted < self.state and started and ts_ns - self.since < seconds(self.config.min_dwell_seconds):
            wanted = self.state
        changed = not started or wanted != self.state
        if changed:
            self.since = ts_ns
        self.state = wanted
        multiplier = self.multiplier(p, base_spread)
        return ACTIONS[wanted], multiplier, base_spread * multiplier, changed

    def multiplier(self, p: float, base_spread: float) -> float:
        c = self.config
        if self.state != 2:
            return {0: c.tighten_factor, 1: 1.0, 3: 0.0}[self.state]
        if c.alpha_mu > 0 and base_spread > 0:
            return min(max(2 * c.alpha_mu * p / base_spread, 1.0), c.max_widen_factor)
        return min(c.widen_factor, c.max_widen_factor)


def simulate(rows: DataFrame, key: str, config: GateConfig | None = None, proba: str = "proba", base_spread: str = "base_spread") -> DataFrame:
    """``rows`` with action, multiplier, spread and changed, one gate for each ``key`` in the order of (ts_ns, seq).

    A gate is a fold, so a key's rows must pass one task in order; they stream through it sorted, never gathered.
    """
    ship(rows.sparkSession)
    config = config or GateConfig()
    kept = [c for c in rows.columns if c not in ("action", "multiplier", "spread", "changed")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate, of = RiskGate(config), None
        for batch in batches:
            out = []
            for k, ts, p, spread in zip(batch[key], batch["ts_ns"], batch[proba], batch[base_spread], strict=True):
                if of is None or k != of[0]:
                    gate, of = RiskGate(config), (k,)
                out.append(gate.update(int(ts), p, spread))
            yield batch.assign(**{c: [o[i] for o in out] for i, c in enumerate(("action", "multiplier", "spread", "changed"))})

    schema = rows.select(*kept).schema.add("action", "string").add("multiplier", "double").add("spread", "double").add("changed", "boolean")
    return rows.select(*kept).repartition(key).sortWithinPartitions(key, "ts_ns", "seq").mapInPandas(run, schema)


def summary(gated: DataFrame, proba: str = "proba") -> DataFrame:
    """action, n, share, mean_proba, mean_multiplier, mean_spread, changes_per_1k (of all updates)."""
    total = gated.agg(F.count("*").alias("_n"), F.count_if("changed").alias("_c"))
    d = gated.groupBy("action").agg(F.count("*").alias("n"), F.avg(proba).alias("mean_proba"), F.avg("multiplier").alias("mean_multiplier"), F.avg("spread").alias("mean_spread")).crossJoin(F.broadcast(total))
    return d.select("action", "n", (F.col("n") / F.col("_n")).alias("share"), "mean_proba", "mean_multiplier", "mean_spread", (1000 * F.col("_c") / F.col("_n")).alias("changes_per_1k"))


def _share(p: Column) -> Column:
    """Cut to [0, 1]; missing stays missing."""
    return F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def gated_signals(rows: DataFrame, signal: str, proba: str, threshold: float = 0.5, method: str = "linear", dust: float = 0.0) -> DataFrame:
    """``rows`` with toxicity_proba (cut to [0, 1]), act, size_multiplier and gated_signal, the signal times its size.

    A missing probability does not act: its size and signal are 0, act is false.
    """
    kept = [c for c in rows.columns if c not in ("toxicity_proba", "act", "size_multiplier", "gated_signal")]
    p = F.nanvl(F.col(proba).cast("double"), F.lit(None).cast("double"))
    d = rows.select(*kept, _share(p).alias("toxicity_proba"), meta_label(p, threshold, method, dust).alias("_m"))
    known = F.col("toxicity_proba").isNotNull()
    act, size = known & F.coalesce(F.col("_m.act"), F.lit(False)), F.when(known, F.col("_m.size")).otherwise(0.0)
    return d.withColumns({"act": act, "size_multiplier": size, "gated_signal": F.col(signal) * size}).drop("_m")


def meta_label(proba: Column, threshold: float = 0.5, method: str = "linear", dust: float = 0.0) -> Column:
    """Struct of act (p below the threshold) and size (multiplier in [0, 1]; 0 below ``dust``)."""
    proba = _share(proba)
    act = proba < threshold
    size = {"linear": 1 - proba / threshold, "kelly": 1 - 2 * proba, "binary": F.lit(1.0)}
    if method not in size:
        raise ValueError(f"unknown method: {method!r}")
    value = F.when(act, F.greatest(F.lit(0.0), F.least(F.lit(1.0), size[method]))).otherwise(0.0)
    return F.struct(act.alias("act"), F.when(value < dust, 0.0).otherwise(value).alias("size"))


