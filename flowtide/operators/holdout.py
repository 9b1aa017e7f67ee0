"""Scores on a holdout with confidence intervals from a block bootstrap.

Fills of one hour are not independent, so whole hours are drawn with replacement. Rows are counted once by score, block
and label; a draw only weighs the blocks. So the number of rows that Spark moves does not depend on the number of draws:
each task makes the draws' weights itself from the seed and returns one row of sums a draw.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..deploy import ship
from ..plans.scratch import written
from .metrics import evaluate

HOUR_NS = 3_600_000_000_000
DRAWS, LEVEL = 300, 0.95


def hour_blocks(ts_ns: str = "ts_ns") -> Column:
    """The hour of a time in nanoseconds, counted from 1970."""
    return F.floor(F.col(ts_ns) / F.lit(HOUR_NS)).cast("long")


def draw_weights(blocks: int, draws: int, seed: int) -> Iterator[np.ndarray]:
    """For each draw, how often each of the blocks comes up; the same in every task."""
    rng = np.random.default_rng(seed)
    for _ in range(draws):
        yield np.bincount(rng.integers(0, blocks, blocks), minlength=blocks)


def _placed(rows: DataFrame, block: str) -> tuple[DataFrame, int]:
    """``rows`` with place, the rank of their block from 0, and the number of blocks."""
    # One row a block: years of hours are some ten thousands.
    places = rows.select(block).distinct().withColumn("place", F.row_number().over(Window.orderBy(block)) - 1)
    return rows.join(places, block), places.count()


def bootstrap_sums(rows: DataFrame, block: str, sums: dict[str, Column], draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """draw and, by name, each sum over the rows as that draw weighs them. An empty table gives no draws."""
    ship(rows.sparkSession)
    names = list(sums)
    held = rows.groupBy(F.col(block).alias("block")).agg(*[F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias(n) for n, c in sums.items()])
    placed, blocks = _placed(held, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((draws, len(names)))
        some = False
        for batch in batches:
            if batch.num_rows:
                some = True
                places = batch.column(0).to_numpy()
                values = np.column_stack([batch.column(i + 1).to_numpy() for i in range(len(names))])
                total += np.array([w[places] @ values for w in draw_weights(blocks, draws, seed)])
        if some:
            columns = [pa.array(np.arange(draws, dtype=np.int32)), *[pa.array(total[:, i].copy()) for i in range(len(names))]]
            yield pa.RecordBatch.from_arrays(columns, ["draw", *names])

    schema = "draw int, " + ", ".join(f"`{n}` double" for n in names)
    partial = placed.select("place", *names).mapInArrow(run, schema)
    return partial.groupBy("draw").agg(*[F.sum(n).alias(n) for n in names])


def bootstrap_ranks(scored: DataFrame, block: str, score: str = "score", label: str = "label", draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """draw, auc and brier_skill of each draw; null where a draw is of one class.

    Counts by score, block and label are dealt by ranges of the score. A range counts, for each draw, the pairs within it
    that the score puts right; a positive row also wins over the negative ones of all lower ranges, whose number comes
    from a table of one row a range and draw.
    """
    ship(scored.sparkSession)
    known = scored.where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(label).isin(0, 1))
    cells = known.groupBy(F.col(score).cast("double").alias("s"), F.col(block).alias("block")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    placed, blocks = _placed(cells, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        rows = pa.Table.from_batches(kept).sort_by("s")
        s, place, pos, neg = (rows.column(i).to_numpy() for i in range(4))
        starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        out = np.empty((draws, 4))
        for d, weights in enumerate(draw_weights(blocks, draws, seed)):
            w = weights[place]
            good, bad = w * pos, w * neg
            p, n = np.add.reduceat(good, starts), np.add.reduceat(bad, starts)
            lower = np.concatenate(([0], np.cumsum(n)[:-1]))
            out[d] = p.sum(), n.sum(), (p * (lower + n / 2)).sum(), (good * (1 - s) ** 2 + bad * s**2).sum()
        columns = [pa.array(np.arange(draws, dtype=np.int32)), pa.array(np.full(draws, s[0])), *[pa.array(out[:, i].copy()) for i in range(4)]]
        yield pa.RecordBatch.from_arrays(columns, ["draw", "low", "pos", "neg", "won", "square"])

    n = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = placed.select("s", "place", "pos", "neg").repartitionByRange(n, "s").mapInArrow(run, "draw int, low double, pos double, neg double, won double, square double")
    lower = Window.partitionBy("draw").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("won") + F.col("pos") * F.coalesce(F.sum("neg").over(lower), F.lit(0.0))
    d = ranges.withColumn("won", won).groupBy("draw").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "won", "square")])
    n_rows, both = F.col("pos") + F.col("neg"), (F.col("pos") > 0) & (F.col("neg") > 0)
    baseline = F.col("pos") * F.col("neg") / (n_rows * n_rows)
    return d.select(
        "draw",
        F.when(both, F.col("won") / (F.col("pos") * F.col("neg"))).alias("auc"),
        F.when(both, 1 - F.col("square") / n_rows / baseline).alias("brier_skill"),
    )


def intervals(drawn: DataFrame, columns: Sequence[str], level: float = LEVEL) -> dict[str, tuple[float | None, float | None]]:
    """Lower and upper bound of each column over the draws (linear quantiles); None where no draw has a value."""
    rows = drawn.select(*columns).collect()  # one row a draw
    out = {}
    for c in columns:
        values = [r[c] for r in rows if r[c] is not None and np.isfinite(r[c])]
        out[c] = tuple(map(float, np.quantile(values, [(1 - level) / 2, (1 + level) / 2]))) if values else (None, None)
    return out


def _bounds(found: dict[str, tuple[float | None, float | None]]) -> list[Column]:
    return [F.lit(v).cast("double").alias(f"{c}_{side}") for c, pair in found.items() for side, v in zip(("low", "high"), pair)]


def holdout_scores(scored: DataFrame, block: str, score: str = "score", label: str = "label", draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """One row: evaluate()'s columns and auc_low, auc_high, brier_skill_low, brier_skill_high.

    Rows without a score or with another label than 0 and 1 count for nothing. A null block counts as -1.
    """
    named = scored.where(~F.isnan(score)).select(F.coalesce(F.col(block), F.lit(-1)).alias("_block"), score, label)
    d = written(named, "scored")
    return evaluate(d, score, label).select("*", *_bounds(intervals(bootstrap_ranks(d, "_block", score, label, draws, seed), ["auc", "brier_skill"])))


def uplift(total: Column, blocked: Column) -> Column:
    """What not taking the blocked fills adds, as a share of the absolute total; null for a total of 0."""
    return F.when(total != 0, -blocked / F.abs(total))


def gate_points(scored: DataFrame, threshold: float, score: str = "score", pnl: str = "pnl") -> DataFrame:
    """One row: threshold, blocked_share, pnl_ungated, pnl_gated, uplift, mean_pnl_blocked, mean_pnl_kept.

    Fills with a score of at least the threshold are blocked; those without score or pnl count for nothing. Null
    without any.
    """
    d = _decided(scored, score, pnl)
    blocked = F.col("_p") >= threshold
    value = F.col("_x")
    d = d.agg(
        F.avg(blocked.cast("double")).alias("blocked_share"),
        F.sum(value).alias("pnl_ungated"),
        F.when(F.count("*") > 0, F.coalesce(F.sum(F.when(~blocked, value)), F.lit(0.0))).alias("pnl_gated"),
        F.coalesce(F.sum(F.when(blocked, value)), F.lit(0.0)).alias("_blocked"),
        F.avg(F.when(blocked, value)).alias("mean_pnl_blocked"),
        F.avg(F.when(~blocked, value)).alias("mean_pnl_kept"),
    )
    share = uplift(F.col("pnl_ungated"), F.col("_blocked"))
    return d.select(F.lit(float(threshold)).alias("threshold"), "blocked_share", "pnl_ungated", "pnl_gated", share.alias("uplift"), "mean_pnl_blocked", "mean_pnl_kept")


def _decided(scored: DataFrame, score: str, pnl: str) -> DataFrame:
    p, x = F.col(score).cast("double"), F.col(pnl).cast("double")
    return scored.withColumns({"_p": p, "_x": x}).where(p.isNotNull() & ~F.isnan(p) & x.isNotNull() & ~F.isnan(x))


def gate_scores(scored: DataFrame, threshold: float, block: str, score: str = "score", pnl: str = "pnl", draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """gate_points() and the bounds of the uplift, uplift_low and uplift_high, from sums by block."""
    value = F.col("_x")
    sums = {"total": value, "blocked": F.when(F.col("_p") >= threshold, value).otherwise(0.0)}
    scored = written(scored.select(F.coalesce(F.col(block), F.lit(-1)).alias("_block"), score, pnl), "scored")
    held = _decided(scored, score, pnl)
    drawn = bootstrap_sums(held, "_block", sums, draws, seed).select(uplift(F.col("total"), F.col("blocked")).alias("uplift"))
    return gate_points(scored, threshold, score, pnl).select("*", *_bounds(intervals(drawn, ["uplift"])))
