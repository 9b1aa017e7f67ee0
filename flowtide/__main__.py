"""python -m flowtide --ticks TICKS --blotter BLOTTER: prints what report.analyse() finds; --export writes the model,
fitted on all fills, and the counterparties' history beside it."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from .operators import features, folds, scoring, splits
from .report import Settings, analyse, text
from .sources import readers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="flowtide", description=__doc__)
    p.add_argument("--ticks", required=True, help="file or folder of quotes")
    p.add_argument("--provider", default="auto", choices=readers.PROVIDERS)
    p.add_argument("--blotter", required=True, help="CSV of timestamp, side, price, size and, if known, counterparty_id")
    p.add_argument("--horizons", type=float, nargs="+", default=list(Settings.horizons), help="markout horizons in seconds")
    p.add_argument("--label-rule", default=Settings.label_rule, choices=("triple_barrier", "crossback", "markout_threshold"))
    p.add_argument("--label-horizon", type=float, default=Settings.label_horizon)
    p.add_argument("--label-threshold", type=float, default=Settings.label_threshold)
    p.add_argument("--vol-multiple", type=float, default=Settings.vol_multiple)
    p.add_argument("--bucket-volume", type=float)
    p.add_argument("--buckets-per-day", type=int, default=Settings.buckets_per_day)
    p.add_argument("--vpin-window", type=int, default=Settings.vpin_window)
    p.add_argument("--holdout", type=float, default=Settings.holdout)
    p.add_argument("--pip", type=float, default=Settings.pip)
    p.add_argument("--no-select-features", dest="select", action="store_false")
    p.add_argument("--calibrate", action="store_true")
    p.add_argument("--export", help="where to write the model (.fxm), on the driver")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    if a.export and a.calibrate:
        p.error("--export writes one linear model; a calibrated one is several")
    if a.export and not Path(a.export).resolve().parent.is_dir():
        p.error("--export: no such folder")
    spark = spark or SparkSession.builder.appName("flowtide").getOrCreate()
    names = ("horizons", "label_rule", "label_horizon", "label_threshold", "vol_multiple", "bucket_volume", "buckets_per_day", "vpin_window", "holdout", "pip", "select", "calibrate")
    try:
        found = analyse(readers.read_ticks(spark, a.ticks, a.provider), readers.read_blotter(spark, a.blotter), Settings(**{n: getattr(a, n) for n in names}))
    except ValueError as e:
        print(f"flowtide: {e}")
        return 1
    print(text(found))
    if a.export:
        # The folds only say which columns to take; the model is of all fills.
        plan = splits.walk_forward(found.matrix.select("fill_id", "ts_ns", "seq"), a.label_horizon, 1)
        model = folds.fit(found.matrix, plan, [found.model.members[0].names]).models[0, folds.EVERY].members[0]
        scoring.verify(model, found.matrix)
        Path(a.export).write_bytes(scoring.dump(model))
        beside = str(Path(a.export).resolve().with_suffix(".cp.csv"))
        readers.write_counterparties_csv(features.counterparty_table(found.matrix), beside)
        print(f"  model: {a.export}; counterparties: {beside}; bucket volume: {found.summary.first()['bucket_volume']:.0f}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
