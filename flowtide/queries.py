"""Queries over the driver's tables, one or more for each operator, and SQL that gives the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report
from .functions.special import norm_cdf_sql, session_label
from .operators import cleaning, export, features, folds, gate, holdout, indicators, labels, learn, markouts, metrics, splits, stationarity, validation, vpin
from .plans.scratch import scratch_path, written
from .plans.series import DAY_NS, seconds
from .sources import fixtures, synthetic
from .sources.fixtures import BUCKET_VOLUME, DAILY_SQL, TICKS_SQL
from .streaming import engine, live

HORIZONS = (600, 3600, 21600, 86400)
H, THETA, GAP = 3600.0, 3e-4, 1800.0
SHORT, LONG = 3600.0, 21600.0
#: Ticks of the fixtures are minutes apart: slices of many days hold a few thousand.
SLICE = 5 * DAY_NS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


#: The prepared series of the query that is being built: all that it reads of ticks and fills is this one table.
_prepared: dict[str, DataFrame] = {}


def query(sql: str | None = None, prepared: bool = False) -> Callable:
    """Registers a query; ``prepared`` ones read ticks and fills so often that their series is written first."""

    def put(f: Callable) -> Callable:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            _prepared.clear()
            if prepared:
                _prepared[sf_dir] = written(fixtures.points(spark, sf_dir), "points")
            try:
                return f(spark, sf_dir)
            finally:
                _prepared.clear()

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions doesn't show; -0 becomes 0."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0::DOUBLE"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared[sf_dir] if sf_dir in _prepared else fixtures.points(spark, sf_dir)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.ticks(_points(spark, sf_dir))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.fills(_points(spark, sf_dir))


# Cleaning

_CLEAN = f"""WITH {TICKS_SQL}, uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts_ns, bid, ask ORDER BY seq DESC) AS n FROM ticks) WHERE n = 1),
sound AS (SELECT *, ln(ask - bid) AS ls FROM uniq WHERE ask > bid),
st AS (SELECT avg(ls) AS m, stddev_pop(ls) AS s, count(*) AS n FROM sound),
clean AS (SELECT sound.* FROM sound, st WHERE NOT (st.n > 2 AND st.s > 0) OR abs(ls - m) < {{z}} * s)"""


@query(_CLEAN.format(z=1.5) + f" SELECT seq, ts_ns, {r('(bid + ask) / 2')} AS mid, {r('ask - bid')} AS spread, volume FROM clean")
def ticks_clean(spark, sf_dir):
    clean, _ = cleaning.clean_ticks(ticks(spark, sf_dir), spread_z=1.5)
    return rounded(clean.select("seq", "ts_ns", "mid", "spread", "volume"))


@query(_CLEAN.format(z=1.5) + " SELECT (SELECT count(*) FROM ticks) AS n_input, (SELECT count(*) FROM ticks) - (SELECT count(*) FROM uniq) AS n_duplicates, (SELECT count(*) FROM uniq) - (SELECT count(*) FROM sound) AS n_crossed, (SELECT count(*) FROM sound) - (SELECT count(*) FROM clean) AS n_outliers, (SELECT count(*) FROM clean) AS n_clean")
def cleaning_report(spark, sf_dir):
    return cleaning.clean_ticks(ticks(spark, sf_dir), spread_z=1.5)[1]


_GAPS = f"""WITH {TICKS_SQL}, g AS (SELECT *, coalesce((ts_ns - lag(ts_ns) OVER (ORDER BY ts_ns, seq)) / 1e9::DOUBLE, 0) AS gap_seconds FROM ticks),
flagged AS (SELECT *, gap_seconds > {GAP} AS gap_flag FROM g)"""


@query(_GAPS + f" SELECT seq, {r('gap_seconds')} AS gap_seconds, gap_flag, cast(sum(gap_flag::BIGINT) OVER (ORDER BY ts_ns, seq) AS BIGINT) AS session_id FROM flagged")
def gap_sessions(spark, sf_dir):
    return rounded(cleaning.flag_gaps(ticks(spark, sf_dir), GAP, slice_ns=SLICE).select("seq", "gap_seconds", "gap_flag", "session_id"))


@query(f"WITH {TICKS_SQL} SELECT cast(ts_ns // 3600000000000 * 3600000000000 AS BIGINT) AS bar_ns, {r('arg_min(mid, (ts_ns, seq))')} AS open, {r('max(mid)')} AS high, {r('min(mid)')} AS low, {r('arg_max(mid, (ts_ns, seq))')} AS close, {r('avg(spread)', 8)} AS spread, sum(volume) AS volume FROM ticks GROUP BY 1")
def ohlc_hourly(spark, sf_dir):
    b = cleaning.bars(ticks(spark, sf_dir), 3600)
    return b.select("bar_ns", *[(F.round(c, 8 if c == "spread" else 6) + F.lit(0.0)).alias(c) for c in ("open", "high", "low", "close", "spread")], "volume")


@query(_GAPS + f" SELECT cast(make_timestamp(ts_ns // 1000) AS DATE) AS day, count(*) AS ticks, {r('avg(spread)', 8)} AS mean_spread, {r('max(gap_seconds)')} AS max_gap_seconds, count(*) FILTER (WHERE gap_flag) AS n_gaps, sum(volume) AS volume FROM flagged GROUP BY 1")
def coverage_daily(spark, sf_dir):
    d = cleaning.coverage(ticks(spark, sf_dir), GAP, slice_ns=SLICE)
    return d.select("day", "ticks", (F.round("mean_spread", 8) + F.lit(0.0)).alias("mean_spread"), F.round("max_gap_seconds", 6).alias("max_gap_seconds"), "n_gaps", "volume")


@query(f"WITH {TICKS_SQL} SELECT CASE WHEN h BETWEEN 12 AND 16 THEN 'london_ny_overlap' WHEN h BETWEEN 7 AND 11 THEN 'london' WHEN h BETWEEN 17 AND 20 THEN 'ny_afternoon' ELSE 'asia' END AS session, count(*) AS n, sum(volume) AS volume FROM (SELECT ts_ns // 3600000000000 % 24 AS h, volume FROM ticks) GROUP BY 1")
def session_counts(spark, sf_dir):
    hour = F.pmod(F.floor(F.col("ts_ns") / 3_600_000_000_000), F.lit(24))
    return ticks(spark, sf_dir).groupBy(session_label(hour).alias("session")).agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))


# VPIN. One bucket volume for tables of every size.

_BUCKETS = f"""WITH {TICKS_SQL}, cfg AS (SELECT {BUCKET_VOLUME}::DOUBLE AS v),
cum AS (SELECT *, sum(volume) OVER (ORDER BY ts_ns, seq) AS c FROM ticks WHERE volume > 0),
closing AS (SELECT *, unnest(generate_series(cast(floor((c - volume) / v) AS BIGINT) + 1, cast(floor(c / v) AS BIGINT))) AS bucket FROM cum, cfg),
dps AS (SELECT bucket, ts_ns AS ts_end, mid AS price_end, v, mid - coalesce(lag(mid) OVER (ORDER BY bucket), (SELECT arg_min(mid, (ts_ns, seq)) FROM ticks)) AS dp FROM closing),
sig AS (SELECT *, CASE WHEN count(*) OVER w >= 2 THEN stddev_pop(dp) OVER w ELSE 0 END AS sigma, count(*) OVER w < 20 AS warmup FROM dps WINDOW w AS (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bought AS (SELECT *, v * CASE WHEN sigma > 0 THEN {norm_cdf_sql('dp / nullif(sigma, 0)')} ELSE 0.5 END AS v_buy FROM sig),
buckets AS (SELECT *, v - v_buy AS v_sell, abs(v_buy - (v - v_buy)) / v AS order_imbalance FROM bought),
rolled AS (SELECT *, CASE WHEN count(*) OVER w >= 10 THEN avg(order_imbalance) OVER w END AS vpin FROM buckets WINDOW w AS (ORDER BY bucket ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
ranked AS (SELECT *, CASE WHEN vpin IS NOT NULL AND (SELECT count(*) FROM rolled b WHERE b.bucket <= a.bucket AND b.vpin IS NOT NULL) >= 30
  THEN (SELECT count(*) FROM rolled b WHERE b.bucket <= a.bucket AND b.vpin <= a.vpin)::DOUBLE / (SELECT count(*) FROM rolled b WHERE b.bucket <= a.bucket AND b.vpin IS NOT NULL) END AS vpin_pctile FROM rolled a)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vpin.vpin(ticks(spark, sf_dir), BUCKET_VOLUME, window=10, slice_ns=SLICE)


@query(_BUCKETS + f" SELECT bucket, ts_end, {r('price_end')} AS price_end, {r('v_buy', 3)} AS v_buy, {r('v_sell', 3)} AS v_sell, {r('order_imbalance')} AS order_imbalance, warmup FROM buckets")
def vpin_buckets(spark, sf_dir):
    b = vpin.buckets(ticks(spark, sf_dir), BUCKET_VOLUME, slice_ns=SLICE)
    return b.select("bucket", "ts_end", F.round("price_end", 6).alias("price_end"), F.round("v_buy", 3).alias("v_buy"), F.round("v_sell", 3).alias("v_sell"), (F.round("order_imbalance", 6) + F.lit(0.0)).alias("order_imbalance"), "warmup")


@query(_BUCKETS + f" SELECT bucket, {r('vpin')} AS vpin FROM rolled")
def vpin_rolling(spark, sf_dir):
    return rounded(vpin.rolling(vpin.buckets(ticks(spark, sf_dir), BUCKET_VOLUME, slice_ns=SLICE), 10).select("bucket", "vpin"))


@query(_BUCKETS + f" SELECT bucket, {r('vpin')} AS vpin, {r('vpin_pctile')} AS vpin_pctile FROM ranked")
def vpin_percentile(spark, sf_dir):
    return rounded(readings(spark, sf_dir).select("bucket", "vpin", "vpin_pctile"))


@query(_BUCKETS + " SELECT CASE WHEN vpin_pctile IS NULL THEN 'unknown' WHEN vpin_pctile >= 0.9 THEN 'toxic' WHEN vpin_pctile <= 0.35 THEN 'benign' ELSE 'neutral' END AS regime, count(*) AS n FROM ranked GROUP BY 1")
def vpin_regime(spark, sf_dir):
    return readings(spark, sf_dir).groupBy(vpin.regime(F.col("vpin_pctile")).alias("regime")).agg(F.count("*").alias("n"))


_TICK_BVC = f"""WITH {TICKS_SQL}, cfg AS (SELECT {BUCKET_VOLUME}::DOUBLE AS v),
steps AS (SELECT *, mid - lag(mid) OVER (ORDER BY ts_ns, seq) AS dp FROM ticks),
cum AS (SELECT *, sum(volume) OVER (ORDER BY ts_ns, seq) AS c, count(dp) OVER w AS n, coalesce(sum(dp) OVER w, 0) AS s1, coalesce(sum(dp * dp) OVER w, 0) AS s2 FROM steps WHERE volume > 0
  WINDOW w AS (ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sig AS (SELECT *, coalesce(dp, 0) AS step, CASE WHEN n >= 2 THEN sqrt(greatest(0, s2 / n - (s1 / n) * (s1 / n))) ELSE 0 END AS sigma FROM cum),
shares AS (SELECT *, CASE WHEN sigma > 0 THEN {norm_cdf_sql('step / nullif(sigma, 0)')} ELSE 0.5 END AS share FROM sig),
parts AS (SELECT *, unnest(generate_series(cast(floor((c - volume) / v) AS BIGINT) + 1, greatest(cast(floor((c - volume) / v) AS BIGINT) + 1, cast(ceil(c / v) AS BIGINT)))) AS bucket FROM shares, cfg),
filled AS (SELECT bucket, v, share * (least(c, bucket * v) - greatest(c - volume, (bucket - 1) * v)) AS bought, c >= bucket * v AS closes FROM parts)"""


@query(_TICK_BVC + f" SELECT bucket, {r('sum(bought)', 3)} AS v_buy, {r('abs(2 * sum(bought) - any_value(v)) / any_value(v)')} AS order_imbalance FROM filled GROUP BY bucket HAVING bool_or(closes)")
def vpin_tick_bvc(spark, sf_dir):
    b = vpin.buckets(ticks(spark, sf_dir), BUCKET_VOLUME, granularity="tick", slice_ns=SLICE)
    return b.select("bucket", F.round("v_buy", 3).alias("v_buy"), (F.round("order_imbalance", 6) + F.lit(0.0)).alias("order_imbalance"))


@query()
def vpin_student_t(spark, sf_dir):
    return vpin.vpin(ticks(spark, sf_dir), BUCKET_VOLUME, window=10, dist="student_t", df=0.25, slice_ns=SLICE)


@query(f"WITH {TICKS_SQL}, t AS (SELECT sum(volume) AS total_volume, greatest((max(ts_ns) - min(ts_ns)) / 86400e9::DOUBLE, 1e-9) AS days FROM ticks) SELECT total_volume, {r('days')} AS days, {r('least(total_volume / (days * 50), total_volume / 400)', 3)} AS bucket_volume FROM t")
def suggest_bucket_volume(spark, sf_dir):
    d = vpin.suggest_bucket_volume(ticks(spark, sf_dir))
    return d.select("total_volume", F.round("days", 6).alias("days"), F.round("bucket_volume", 3).alias("bucket_volume"))


@query(_BUCKETS + f" SELECT {r('stddev_pop(dp)', 8)} AS sigma FROM dps")
def full_sample_sigma(spark, sf_dir):
    return rounded(vpin.full_sample_sigma(ticks(spark, sf_dir), BUCKET_VOLUME), 8)


@query(_BUCKETS + f" SELECT f.fill_id, {r('k.vpin')} AS vpin, {r('k.vpin_pctile')} AS vpin_pctile FROM fills f ASOF LEFT JOIN (SELECT * FROM (SELECT ts_end, bucket, vpin, vpin_pctile, row_number() OVER (PARTITION BY ts_end ORDER BY bucket DESC) AS n FROM ranked) WHERE n = 1) k ON f.ts_ns >= k.ts_end")
def vpin_attach(spark, sf_dir):
    d = vpin.attach(fills(spark, sf_dir), readings(spark, sf_dir), slice_ns=SLICE)
    return rounded(d.select("fill_id", "vpin", "vpin_pctile"))


# Markouts

_MARKS = f"""WITH {TICKS_SQL}, lastt AS (SELECT max(ts_ns) AS e FROM ticks), one AS (SELECT ts_ns, arg_max(mid, seq) AS mid FROM ticks GROUP BY 1),
probes AS (SELECT fill_id, sign, price, counterparty_id, h, ts_ns + h::BIGINT * 1000000000 AS target FROM fills, (VALUES (0), {', '.join(f'({h})' for h in HORIZONS)}) hs(h)),
found AS (SELECT p.*, CASE WHEN h = 0 OR target <= e THEN o.mid END AS m FROM (SELECT * FROM probes, lastt) p ASOF LEFT JOIN one o ON p.target >= o.ts_ns),
marked AS (SELECT fill_id, any_value(sign) AS sign, any_value(counterparty_id) AS counterparty_id, max(m) FILTER (WHERE h = 0) AS mid_at_fill, any_value(sign) * (any_value(price) - max(m) FILTER (WHERE h = 0)) AS effective_half_spread,
  {', '.join(f'any_value(sign) * (any_value(price) - max(m) FILTER (WHERE h = {h})) AS markout_{h}s' for h in HORIZONS)} FROM found GROUP BY 1)"""
_NAMES = [f"markout_{h}s" for h in HORIZONS]


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markouts.markouts(fills(spark, sf_dir), ticks(spark, sf_dir), HORIZONS, slice_ns=SLICE)


@query(_MARKS + f" SELECT fill_id, {', '.join(r(c) + f' AS {c}' for c in _NAMES)} FROM marked")
def markout_values(spark, sf_dir):
    return rounded(marked(spark, sf_dir).select("fill_id", *_NAMES))


@query(_MARKS + f" SELECT fill_id, {r('mid_at_fill')} AS mid_at_fill, {r('effective_half_spread')} AS effective_half_spread FROM marked")
def mid_at_fill(spark, sf_dir):
    return rounded(marked(spark, sf_dir).select("fill_id", "mid_at_fill", "effective_half_spread"))


@query(_MARKS + " " + " UNION ALL ".join(f"SELECT {h}::DOUBLE AS horizon_seconds, {r(f'avg(markout_{h}s)', 9)} AS mean_markout, count(markout_{h}s) AS n_observed FROM marked" for h in HORIZONS))
def markout_summary(spark, sf_dir):
    return rounded(markouts.summary(marked(spark, sf_dir), HORIZONS), 9)


@query(_MARKS + f" SELECT counterparty_id, count(*) AS n_fills, {', '.join(r(f'avg({c})', 9) + f' AS {c}' for c in _NAMES)} FROM marked GROUP BY 1")
def markout_by_cp(spark, sf_dir):
    return rounded(markouts.summary(marked(spark, sf_dir), HORIZONS, "counterparty_id"), 9)


@query()
def markout_curve_fit(spark, sf_dir):
    fit = markouts.fit_curve(marked(spark, sf_dir), HORIZONS)
    return spark.createDataFrame([(fit["half_spread"], fit["alpha_mu"], fit["lambda"], fit["identified"], fit["empirical_decay"])], "half_spread double, alpha_mu double, lambda double, identified boolean, empirical_decay double")


# Labels


@query(_MARKS + " SELECT fill_id, CASE WHEN markout_3600s IS NULL THEN -1 WHEN round(markout_3600s, 9) < -0.0001 THEN 1 ELSE 0 END AS label FROM marked")
def labels_markout(spark, sf_dir):
    m = marked(spark, sf_dir).withColumn("markout_3600s", F.round("markout_3600s", 9))
    return labels.label(m, ticks(spark, sf_dir), "markout_threshold", H, 1e-4).select("fill_id", "label")


def _path(up: str, down: str, verdict: str) -> str:
    return f"""WITH {TICKS_SQL}, lastt AS (SELECT max(ts_ns) AS e FROM ticks), one AS (SELECT ts_ns, arg_max(mid, seq) AS mid FROM ticks GROUP BY 1),
probes AS (SELECT f.*, o.mid FROM (SELECT * FROM fills, lastt) f ASOF LEFT JOIN one o ON f.ts_ns >= o.ts_ns),
barred AS (SELECT *, {up} AS up, {down} AS down FROM probes),
hits AS (SELECT b.fill_id, any_value(b.sign) AS sign, any_value(b.ts_ns) AS t0, any_value(e) AS e, any_value(b.mid) AS mid0, count(t.seq) AS n, min((t.ts_ns, t.seq)) FILTER (WHERE t.mid >= up) AS u, min((t.ts_ns, t.seq)) FILTER (WHERE t.mid <= down) AS d
  FROM barred b LEFT JOIN ticks t ON t.ts_ns > b.ts_ns AND t.ts_ns <= b.ts_ns + {seconds(H)} GROUP BY 1),
sided AS (SELECT *, CASE WHEN sign > 0 THEN u ELSE d END AS good, CASE WHEN sign > 0 THEN d ELSE u END AS bad FROM hits),
labelled AS (SELECT fill_id, CASE WHEN mid0 IS NULL OR t0 + {seconds(H)} > e OR n = 0 THEN -1 WHEN {verdict} THEN 1 ELSE 0 END AS label FROM sided)"""


_CROSS = _path("CASE WHEN sign > 0 THEN price + 0.0 END", "CASE WHEN sign < 0 THEN price - 0.0 END", "good IS NOT NULL")
_TRIPLE = _path(f"mid + {THETA}", f"mid - {THETA}", "good IS NOT NULL AND (bad IS NULL OR good < bad)")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label(fills(spark, sf_dir), ticks(spark, sf_dir), "triple_barrier", H, THETA, slice_ns=SLICE)


@query(_CROSS + " SELECT fill_id, label FROM labelled", prepared=True)
def labels_crossback(spark, sf_dir):
    return labels.label(fills(spark, sf_dir), ticks(spark, sf_dir), "crossback", H, slice_ns=SLICE).select("fill_id", "label")


@query(_TRIPLE + " SELECT fill_id, label FROM labelled", prepared=True)
def labels_triple_barrier(spark, sf_dir):
    return labelled(spark, sf_dir).select("fill_id", "label")


_REPORT = f"count(*) AS n, count(*) FILTER (WHERE label = 1) AS toxic, count(*) FILTER (WHERE label = 0) AS benign, count(*) FILTER (WHERE label < 0) AS undecidable, {r('count(*) FILTER (WHERE label = 1)::DOUBLE / nullif(count(*) FILTER (WHERE label >= 0), 0)')} AS toxic_rate"


@query(_TRIPLE + f" SELECT {_REPORT} FROM labelled", prepared=True)
def label_report(spark, sf_dir):
    return rounded(labels.report(labelled(spark, sf_dir)))


@query(_TRIPLE + f" SELECT counterparty_id, {_REPORT} FROM labelled JOIN fills USING (fill_id) GROUP BY 1", prepared=True)
def label_report_by_cp(spark, sf_dir):
    return rounded(labels.report(labelled(spark, sf_dir), "counterparty_id"))


@query(f"""WITH {TICKS_SQL}, n AS (SELECT greatest(count(*) // 5000, 1) AS step FROM ticks), numbered AS (SELECT *, row_number() OVER (ORDER BY ts_ns, seq) - 1 AS i FROM ticks),
ends AS (SELECT ts_ns, arg_max(mid, seq) AS mid, max(i) AS i FROM numbered GROUP BY 1),
moves AS (SELECT abs(b.mid - a.mid) AS move FROM (SELECT *, ts_ns + {seconds(H)} AS target FROM numbered, n WHERE i % step = 0) a ASOF JOIN ends b ON a.target >= b.ts_ns WHERE b.i > a.i)
SELECT {r('quantile_cont(move, 0.5)', 9)} AS horizon_vol, count(*) AS n_windows, {r('quantile_cont(move, 0.5)', 9)} AS theta FROM moves""")
def suggest_theta(spark, sf_dir):
    return rounded(labels.suggest_theta(ticks(spark, sf_dir), H), 9)


_EXCURSION = f"""WITH {TICKS_SQL}, lastt AS (SELECT max(ts_ns) AS e FROM ticks),
x AS (SELECT f.fill_id, max(f.sign * (t.mid - f.price)) AS excursion FROM fills f, lastt, ticks t WHERE t.ts_ns > f.ts_ns AND t.ts_ns <= f.ts_ns + {seconds(H)} AND f.ts_ns + {seconds(H)} <= e GROUP BY 1)"""
_THETAS = (5e-05, 0.00015, 0.00025, 0.00045, 0.00085)


@query(_EXCURSION + " " + " UNION ALL ".join(f"SELECT {x}::DOUBLE AS theta, {r(f'avg((round(excursion, 9) >= {x})::INT)')} AS toxic_rate FROM x" for x in _THETAS), prepared=True)
def barrier_curve(spark, sf_dir):
    e = labels.adverse_excursion(fills(spark, sf_dir), ticks(spark, sf_dir), H, slice_ns=SLICE).withColumn("excursion", F.round("excursion", 9))
    return rounded(labels.barrier_rates(e, _THETAS))


# Features

_FEATURES = f"""WITH {TICKS_SQL}, prev AS (SELECT *, lag(mid) OVER (ORDER BY ts_ns, seq) AS pm, lag(ts_ns) OVER (ORDER BY ts_ns, seq) AS pt FROM ticks),
tk AS (SELECT *, coalesce(ln(mid / pm) * ln(mid / pm), 0) AS sq, ask - bid AS spr, (bid_size - ask_size) / (bid_size + ask_size) AS o,
  ((bid * ask_size + ask * bid_size) / (bid_size + ask_size) - (bid + ask) / 2) / (ask - bid) AS md, (ts_ns - pt) / 1e9::DOUBLE AS dt, ts_ns % 86400000000000 / 1e9::DOUBLE AS sod FROM prev),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts_ns ORDER BY seq DESC) AS rn FROM tk) WHERE rn = 1),
now AS (SELECT f.fill_id, f.ts_ns, f.size, o.spr, o.o, o.md, o.dt, o.sod FROM fills f ASOF LEFT JOIN one o ON f.ts_ns >= o.ts_ns),
win AS (SELECT f.fill_id, sqrt(sum(sq) FILTER (WHERE t.ts_ns >= f.ts_ns - {seconds(SHORT)})) AS rv_short, sqrt(sum(sq)) AS rv_long,
  sum(t.volume) FILTER (WHERE t.ts_ns >= f.ts_ns - {seconds(SHORT)}) AS vol_short, sum(t.volume) AS vol_long,
  count(*) FILTER (WHERE t.ts_ns >= f.ts_ns - {seconds(SHORT)}) AS n_short, avg(spr) FILTER (WHERE t.ts_ns >= f.ts_ns - {seconds(SHORT)}) AS spread_mean
  FROM fills f JOIN tk t ON t.ts_ns <= f.ts_ns AND t.ts_ns >= f.ts_ns - {seconds(LONG)} GROUP BY 1)
SELECT fill_id, {r('spr')} AS spread, {r('o')} AS obi, {r('md')} AS micro_dev, {r('rv_short', 9)} AS rv_short, {r('rv_long', 9)} AS rv_long, vol_short, vol_long, {r('size / nullif(vol_short, 0)')} AS size_rel_vol,
  {r(f'n_short / {SHORT}::DOUBLE', 9)} AS tick_rate, {r('spread_mean', 9)} AS spread_mean, {r('spr / spread_mean')} AS spread_rel, {r('dt')} AS dt_last_tick, {r('sod')} AS sec_of_day FROM now JOIN win USING (fill_id)"""


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.core_features(fills(spark, sf_dir), ticks(spark, sf_dir), SHORT, LONG, slice_ns=SLICE)


@query(_FEATURES)
def features_core(spark, sf_dir):
    d = featured(spark, sf_dir).select("fill_id", *features.CORE)
    nine = ("rv_short", "rv_long", "tick_rate", "spread_mean")
    return d.select("fill_id", *[(F.round(c, 9 if c in nine else 6) + F.lit(0.0)).alias(c) for c in features.CORE])


@query(f"WITH f AS ({_FEATURES}) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'avg(({c} IS NULL)::INT)')} AS nan_rate, {r(f'stddev_samp({c})', 5)} AS std, count(DISTINCT {c}) AS n_unique FROM f" for c in ("obi", "vol_short", "dt_last_tick")))
def feature_health(spark, sf_dir):
    d = features.health(features_core(spark, sf_dir), ("obi", "vol_short", "dt_last_tick"))
    return d.select("feature", F.round("nan_rate", 6).alias("nan_rate"), F.round("std", 5).alias("std"), "n_unique")


def _history(frame: str) -> str:
    return _TRIPLE + f""", known AS (SELECT fill_id, seq, ts_ns, counterparty_id, label, sum((label >= 0)::INT) OVER w AS n0, sum((label = 1)::INT) OVER w AS b0 FROM labelled JOIN fills USING (fill_id)
  WINDOW w AS (PARTITION BY counterparty_id {frame}))
SELECT fill_id, cast(coalesce(n0, 0) AS BIGINT) AS cp_fill_count, {r('(coalesce(b0, 0) + 2.5) / (coalesce(n0, 0) + 5.0)')} AS cp_toxic_rate_hist FROM known"""


@query(_history("ORDER BY ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"), prepared=True)
def cp_history(spark, sf_dir):
    return rounded(features.counterparty_history(labelled(spark, sf_dir)).select("fill_id", "cp_fill_count", "cp_toxic_rate_hist"))


@query(_history(f"ORDER BY ts_ns RANGE BETWEEN UNBOUNDED PRECEDING AND {seconds(H)} PRECEDING"), prepared=True)
def cp_history_delayed(spark, sf_dir):
    return rounded(features.counterparty_history(labelled(spark, sf_dir), H).select("fill_id", "cp_fill_count", "cp_toxic_rate_hist"))


@query(_TRIPLE + " SELECT counterparty_id, dense_rank() OVER (ORDER BY counterparty_id) - 1 AS code, count(*) FILTER (WHERE label = 1) AS toxic, count(*) FILTER (WHERE label >= 0) AS total FROM labelled JOIN fills USING (fill_id) GROUP BY 1", prepared=True)
def cp_table(spark, sf_dir):
    return features.counterparty_table(labelled(spark, sf_dir))


_FFD = features.ffd_weights(0.4)


@query(f"WITH {TICKS_SQL}, held AS (SELECT seq, list(mid) OVER (ORDER BY ts_ns, seq ROWS BETWEEN {len(_FFD) - 1} PRECEDING AND CURRENT ROW) AS l FROM ticks) SELECT seq, CASE WHEN len(l) = {len(_FFD)} THEN {r(f'list_dot_product(l, {_FFD}::DOUBLE[])')} END AS mid_ffd FROM held")
def fracdiff(spark, sf_dir):
    return rounded(features.frac_diff(ticks(spark, sf_dir), "mid", 0.4).select("seq", "mid_ffd"))


# Unit roots. Their regressions, lags and p-values are beyond SQL; tests compare them with plain least squares.


@query()
def stationarity_report(spark, sf_dir):
    return stationarity.stationarity_report(ticks(spark, sf_dir), ("mid", "spread", "volume"), slice_ns=SLICE)


@query()
def min_ffd_order(spark, sf_dir):
    return stationarity.min_ffd_order(ticks(spark, sf_dir), "mid", slice_ns=SLICE)


@query()
def ffd_features(spark, sf_dir):
    """The columns that are differenced by default, each by the least order that makes it stationary."""
    readings = vpin.vpin(ticks(spark, sf_dir), BUCKET_VOLUME, slice_ns=SLICE)
    given = vpin.attach(featured(spark, sf_dir), readings, slice_ns=SLICE)
    given = written(given.select("fill_id", "ts_ns", "seq", "vpin", "spread_mean"), "ffd-features")
    out, orders = stationarity.add_fractional_differencing(given, slice_ns=SLICE)
    chosen = [F.lit(d).alias(f"{c}_order") for c, d in orders.items()]
    return out.select("fill_id", "vpin", "vpin_ffd", "spread_mean", "spread_mean_ffd", *chosen)


@query()
def feature_health_adf(spark, sf_dir):
    return stationarity.health(featured(spark, sf_dir), features.CORE, slice_ns=SLICE)


# Splits

_EVENTS = f"WITH {TICKS_SQL}, ev AS (SELECT fill_id, ts_ns, row_number() OVER (ORDER BY ts_ns, seq) - 1 AS i FROM fills), span AS (SELECT count(*) AS n, cast(round(0.01::DOUBLE * (max(ts_ns) - min(ts_ns))) AS BIGINT) AS gap FROM ev)"


@query(_EVENTS + f""", folded AS (SELECT *, ntile(5) OVER (ORDER BY i) - 1 AS own FROM ev), bounds AS (SELECT own AS fold, min(ts_ns) AS s, max(ts_ns) + {seconds(H)} AS e FROM folded GROUP BY 1),
roles AS (SELECT cast(fold AS INT) AS fold, CASE WHEN own = fold THEN 'test' WHEN (ts_ns + {seconds(H)} < s OR ts_ns > e) AND NOT (ts_ns > e AND ts_ns <= e + gap) THEN 'train' END AS role, fill_id FROM folded, bounds, span)
SELECT fold, role, fill_id FROM roles WHERE role IS NOT NULL""")
def kfold_purged(spark, sf_dir):
    return splits.purged_kfold(fills(spark, sf_dir), H).select("fold", "role", "fill_id")


_WALK = _EVENTS + f""", plan AS (SELECT k AS fold, first + k * size AS lo, first + (k + 1) * size AS hi FROM (SELECT cast(floor(n * 0.4::DOUBLE) AS BIGINT) AS first, (n - cast(floor(n * 0.4::DOUBLE) AS BIGINT)) // 5 AS size FROM span), range(5) t(k)),
starts AS (SELECT plan.*, ts_ns AS start FROM plan JOIN ev ON ev.i = lo),
roles AS (SELECT cast(fold AS INT) AS fold, CASE WHEN i >= lo AND i < hi THEN 'test' WHEN i < lo AND ts_ns + {seconds(H)} <= start - gap THEN 'train' END AS role, fill_id FROM ev, starts, span)
SELECT fold, role, fill_id FROM roles WHERE role IS NOT NULL"""


@query(_WALK)
def walk_forward(spark, sf_dir):
    return splits.walk_forward(fills(spark, sf_dir), H).select("fold", "role", "fill_id")


@query(_EVENTS + f""", cut AS (SELECT cast(floor(n * 0.75::DOUBLE) AS BIGINT) AS first, gap FROM span), start AS (SELECT ts_ns - gap AS cutoff, first FROM ev, cut WHERE i = first),
roles AS (SELECT CASE WHEN i >= first THEN 'test' WHEN ts_ns + {seconds(H)} < cutoff THEN 'dev' END AS role, fill_id FROM ev, start) SELECT role, fill_id FROM roles WHERE role IS NOT NULL""")
def holdout_split(spark, sf_dir):
    return splits.holdout(fills(spark, sf_dir), H).select("role", "fill_id")


# Scores. A made-up probability with ties stands for a model's.

_SCORED = _TRIPLE + f""", marks AS ({_MARKS} SELECT fill_id, markout_3600s FROM marked), scored AS (SELECT fill_id, label, (fill_id * 37 + 11) % 101 / 100::DOUBLE AS score, round(markout_3600s, 9) AS pnl FROM labelled JOIN marks USING (fill_id))"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = labelled(spark, sf_dir).select("fill_id", "seq", "ts_ns", "counterparty_id", "label")
    return d.withColumn("score", F.pmod(F.col("fill_id") * 37 + 11, F.lit(101)) / 100)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judged() with pnl, the markout after an hour."""
    m = marked(spark, sf_dir).select("fill_id", F.round("markout_3600s", 9).alias("pnl"))
    return judged(spark, sf_dir).join(m, "fill_id")


@query(_SCORED + f""", t AS (SELECT score, label FROM scored WHERE label >= 0), per AS (SELECT score AS s, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS p FROM t GROUP BY 1),
cum AS (SELECT *, coalesce(sum(n) OVER w, 0) AS nb, coalesce(sum(p) OVER w, 0) AS pb, sum(n) OVER () AS nn, sum(p) OVER () AS pp FROM per WINDOW w AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT any_value(nn) AS n, any_value(pp) / any_value(nn) AS base_rate, sum(p * ((nb - pb) + (n - p) / 2)) / (any_value(pp) * (any_value(nn) - any_value(pp))) AS auc, sum(p * (pp - pb) / (nn - nb)) / any_value(pp) AS ap,
  (SELECT avg((score - label) * (score - label)) FROM t) AS brier, (SELECT -avg(label * ln(least(greatest(score, 1e-9), 1 - 1e-9)) + (1 - label) * ln(1 - least(greatest(score, 1e-9), 1 - 1e-9))) FROM t) AS ll FROM cum)
SELECT n::BIGINT AS n, {r('base_rate')} AS base_rate,
  CASE WHEN base_rate > 0 AND base_rate < 1 THEN {r('auc')} END AS auc,
  CASE WHEN base_rate > 0 AND base_rate < 1 THEN {r('ap')} END AS avg_precision,
  CASE WHEN base_rate > 0 AND base_rate < 1 THEN {r('brier')} END AS brier,
  CASE WHEN base_rate > 0 AND base_rate < 1 THEN {r('ll')} END AS log_loss,
  CASE WHEN base_rate > 0 AND base_rate < 1 THEN {r('base_rate * (1 - base_rate)')} END AS brier_baseline,
  CASE WHEN base_rate > 0 AND base_rate < 1 THEN {r('1 - brier / (base_rate * (1 - base_rate))')} END AS brier_skill
FROM m""", prepared=True)
def evaluation(spark, sf_dir):
    return rounded(metrics.evaluate(judged(spark, sf_dir)))


def _binned(source: str, bins: int) -> str:
    edges = ", ".join(f"quantile_cont(score, {i / bins}::DOUBLE)" for i in range(bins + 1))
    return f", e AS (SELECT list_distinct([{edges}]) AS es FROM {source}), binned AS (SELECT {source}.*, cast(greatest(len(list_filter(es, lambda x: x < score)) - 1, 0) AS INT) AS bin FROM {source}, e)"


@query(_SCORED + ", t AS (SELECT * FROM scored WHERE label >= 0)" + _binned("t", 10) + f" SELECT bin, count(*) AS n, {r('avg(score)')} AS mean_predicted, {r('avg(label)')} AS frac_positive, {r('abs(avg(score) - avg(label))')} AS calibration_error FROM binned GROUP BY 1", prepared=True)
def reliability(spark, sf_dir):
    return rounded(metrics.reliability(judged(spark, sf_dir).where("label >= 0")))


_DECILES = _SCORED + ", t AS (SELECT * FROM scored WHERE pnl IS NOT NULL)" + _binned("t", 10) + ", dec AS (SELECT bin AS decile, count(*) AS n, avg(score) AS mean_proba, avg(pnl) AS mean_pnl, sum(pnl) AS total_pnl, stddev_samp(pnl) AS pnl_std FROM binned GROUP BY 1)"


@query(_DECILES + f" SELECT decile, n, {r('mean_proba')} AS mean_proba, {r('mean_pnl', 8)} AS mean_pnl, {r('total_pnl')} AS total_pnl, {r('pnl_std', 8)} AS pnl_std, {r('sum(total_pnl) OVER (ORDER BY decile)')} AS cumulative_pnl FROM dec")
def pnl_deciles(spark, sf_dir):
    d = metrics.pnl_deciles(scored(spark, sf_dir), "score", "pnl")
    return d.select("decile", "n", *[(F.round(c, 8 if c in ("mean_pnl", "pnl_std") else 6) + F.lit(0.0)).alias(c) for c in ("mean_proba", "mean_pnl", "total_pnl", "pnl_std", "cumulative_pnl")])


@query(_DECILES + f", rk AS (SELECT rank() OVER (ORDER BY mean_proba) + (count(*) OVER (PARTITION BY mean_proba) - 1) / 2.0 AS a, rank() OVER (ORDER BY mean_pnl) + (count(*) OVER (PARTITION BY mean_pnl) - 1) / 2.0 AS b FROM dec) SELECT {r('corr(a, b)')} AS rho FROM rk")
def spearman_monotonicity(spark, sf_dir):
    return rounded(metrics.spearman(metrics.pnl_deciles(scored(spark, sf_dir), "score", "pnl"), "mean_proba", "mean_pnl"))


_CUTS = (0.205, 0.505, 0.805, 0.955)


@query(_SCORED + f", g AS (SELECT thr AS threshold, count(*) AS n_fills, count(*) FILTER (WHERE score >= thr) AS n_blocked, sum(pnl) AS pnl_ungated, coalesce(sum(pnl) FILTER (WHERE score < thr), 0) - 0.00001 * count(*) FILTER (WHERE score >= thr AND pnl > 0) AS gated, avg(pnl) FILTER (WHERE score >= thr) AS mb, avg(pnl) FILTER (WHERE score < thr) AS mk, 0.00001 * count(*) FILTER (WHERE score >= thr AND pnl > 0) AS oc FROM scored, (VALUES {', '.join(f'({c}::DOUBLE)' for c in _CUTS)}) v(thr) WHERE pnl IS NOT NULL GROUP BY 1) SELECT threshold, n_fills, n_blocked, {r('n_blocked::DOUBLE / n_fills')} AS blocked_share, {r('pnl_ungated')} AS pnl_ungated, {r('gated')} AS pnl_gated, {r('gated - pnl_ungated')} AS pnl_improvement, {r('mb')} AS mean_pnl_blocked, {r('mk')} AS mean_pnl_kept, {r('oc::DOUBLE')} AS opportunity_cost FROM g")
def gate_sweep(spark, sf_dir):
    return rounded(metrics.gate_sweep(scored(spark, sf_dir), "score", "pnl", _CUTS, 1e-5))


@query(prepared=True)
def holdout_scores(spark, sf_dir):
    """evaluation's values, with bounds from 300 draws of hours."""
    d = judged(spark, sf_dir).withColumn("hour", holdout.hour_blocks())
    return rounded(holdout.holdout_scores(d.where("label >= 0"), "hour"))


@query(
    _SCORED
    + f""", t AS (SELECT score, pnl, score >= 0.505 AS b FROM scored WHERE pnl IS NOT NULL)
SELECT 0.505::DOUBLE AS threshold, {r('avg(b::INT)')} AS blocked_share, {r('sum(pnl)')} AS pnl_ungated, {r('coalesce(sum(pnl) FILTER (WHERE NOT b), 0)')} AS pnl_gated,
  {r('CASE WHEN sum(pnl) <> 0 THEN -coalesce(sum(pnl) FILTER (WHERE b), 0) / abs(sum(pnl)) END')} AS uplift, {r('avg(pnl) FILTER (WHERE b)', 8)} AS mean_pnl_blocked, {r('avg(pnl) FILTER (WHERE NOT b)', 8)} AS mean_pnl_kept FROM t"""
)
def gate_points(spark, sf_dir):
    means = [(F.round(c, 8) + F.lit(0.0)).alias(c) for c in ("mean_pnl_blocked", "mean_pnl_kept")]
    d = holdout.gate_points(scored(spark, sf_dir), 0.505)
    return d.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("threshold", "blocked_share", "pnl_ungated", "pnl_gated", "uplift")], *means)


@query(prepared=True)
def gate_scores(spark, sf_dir):
    """gate_points' values, with bounds of the uplift from 300 draws of hours."""
    return rounded(holdout.gate_scores(scored(spark, sf_dir).withColumn("hour", holdout.hour_blocks()), 0.505, "hour"))


@query(_SCORED + " SELECT fill_id, score < 0.505 AS act, round(CASE WHEN score < 0.505 THEN 1 - score / 0.505 ELSE 0 END, 6) + 0.0::DOUBLE AS size FROM scored")
def meta_gate(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("fill_id", F.inline(F.array(gate.meta_label(F.col("score"), 0.505)))).select("fill_id", "act", "size"))


@query(
    _SCORED
    + f""", s AS (SELECT fill_id, fill_id % 3 - 1 AS signal, least(greatest(score * 1.4 - 0.2, 0), 1) AS p FROM scored),
m AS (SELECT *, p < 0.505 AS act, CASE WHEN p < 0.505 THEN 1 - p / 0.505 ELSE 0 END AS m FROM s), z AS (SELECT *, CASE WHEN m >= 0.1 THEN m ELSE 0 END AS size FROM m)
SELECT fill_id, {r('p')} AS toxicity_proba, act, {r('size')} AS size_multiplier, {r('signal * size')} AS gated_signal FROM z"""
)
def gated_signals(spark, sf_dir):
    d = scored(spark, sf_dir).select("fill_id", (F.pmod("fill_id", F.lit(3)) - 1).alias("signal"), (F.col("score") * 1.4 - 0.2).alias("p"))
    return rounded(gate.gated_signals(d, "signal", "p", 0.505, dust=0.1).select("fill_id", "toxicity_proba", "act", "size_multiplier", "gated_signal"))


@query(prepared=True)
def drift_report(spark, sf_dir):
    return rounded(metrics.drift_report(judged(spark, sf_dir), {"auc": 0.5, "brier": 0.25}))


@query()
def analytic_properties(spark, sf_dir):
    return validation.analytic_properties(ticks(spark, sf_dir), BUCKET_VOLUME, slice_ns=SLICE)


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scored(spark, sf_dir).select("fill_id", "seq", "ts_ns", "counterparty_id", F.col("score").alias("proba"), F.lit(1e-4).alias("base_spread"))
    return gate.simulate(d, "counterparty_id", gate.GateConfig(min_dwell_seconds=7200.0, alpha_mu=1e-4))


_GATE = _SCORED + f""", f AS (SELECT s.fill_id, s.score AS p, x.ts_ns, x.counterparty_id AS cp, row_number() OVER (PARTITION BY x.counterparty_id ORDER BY x.ts_ns, x.seq) AS i FROM scored s JOIN fills x USING (fill_id)),
walk AS (
  WITH RECURSIVE w(cp, i, fill_id, p, st, since, changed) AS (
    SELECT cp, i, fill_id, p, CASE WHEN p >= 0.85 THEN 3 WHEN p >= 0.65 THEN 2 WHEN p <= 0.35 THEN 0 ELSE 1 END, ts_ns, true FROM f WHERE i = 1
    UNION ALL
    SELECT cp, i, fill_id, p, nst, CASE WHEN nst <> st THEN ts_ns ELSE since END, nst <> st FROM (
      SELECT *, CASE WHEN target < st AND ts_ns - since < 7200000000000 THEN st ELSE target END AS nst FROM (
        SELECT f.cp, f.i, f.fill_id, f.p, f.ts_ns, w.st, w.since, CASE WHEN (w.st = 3 AND f.p > 0.85::DOUBLE - 0.05::DOUBLE) OR f.p >= 0.85 THEN 3 WHEN (w.st = 2 AND f.p > 0.65::DOUBLE - 0.05::DOUBLE) OR f.p >= 0.65 THEN 2 WHEN f.p <= 0.35 THEN 0 ELSE 1 END AS target
        FROM w JOIN f ON f.cp = w.cp AND f.i = w.i + 1)))
  SELECT * FROM w),
gated AS (SELECT *, CASE st WHEN 0 THEN 'tighten' WHEN 1 THEN 'normal' WHEN 2 THEN 'widen' ELSE 'suspend' END AS action, CASE st WHEN 0 THEN 0.9 WHEN 1 THEN 1.0 WHEN 3 THEN 0.0 ELSE least(greatest(2 * 0.0001 * p / 0.0001, 1.0), 5.0) END::DOUBLE AS multiplier FROM walk)"""


@query(_GATE + f" SELECT fill_id, action, {r('multiplier')} AS multiplier, changed FROM gated")
def gate_simulation(spark, sf_dir):
    return rounded(gated(spark, sf_dir).select("fill_id", "action", "multiplier", "changed"))


@query(_GATE + f" SELECT action, count(*) AS n, {r('count(*)::DOUBLE / (SELECT count(*) FROM gated)')} AS share, {r('avg(p)')} AS mean_proba, {r('avg(multiplier)')} AS mean_multiplier FROM gated GROUP BY 1")
def gate_summary(spark, sf_dir):
    return rounded(gate.summary(gated(spark, sf_dir)).select("action", "n", "share", "mean_proba", "mean_multiplier"))


@query(_MARKS + f", daily AS (SELECT f.ts_ns // 86400000000000 AS t, avg(-m.markout_3600s) AS alpha_mu FROM marked m JOIN fills f USING (fill_id) WHERE m.markout_3600s IS NOT NULL GROUP BY 1), w AS (SELECT *, count(*) OVER w AS n, avg(alpha_mu) OVER w AS m, stddev_samp(alpha_mu) OVER w AS s FROM daily WINDOW w AS (ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT t, {r('alpha_mu', 9)} AS alpha_mu, {r('CASE WHEN n >= 5 THEN m END', 9)} AS rolling_mean, {r('CASE WHEN n >= 5 THEN (alpha_mu - m) / nullif(s, 0) END')} AS zscore, coalesce(n >= 5 AND abs((alpha_mu - m) / nullif(s, 0)) > 2, false) AS drifted FROM w")
def alpha_drift(spark, sf_dir):
    day = F.floor(F.col("ts_ns") / DAY_NS).cast("long").alias("t")
    history = marked(spark, sf_dir).where("markout_3600s is not null").groupBy(day).agg(F.avg(-F.col("markout_3600s")).alias("alpha_mu"))
    d = metrics.alpha_drift(history)
    return d.select("t", F.round("alpha_mu", 9).alias("alpha_mu"), F.round("rolling_mean", 9).alias("rolling_mean"), F.round("zscore", 6).alias("zscore"), "drifted")


@query(_MARKS + f" SELECT counterparty_id, count(*) AS n_fills, {r('avg(markout_3600s)', 9)} AS mean_markout FROM marked GROUP BY 1 HAVING count(*) >= 20 ORDER BY avg(markout_3600s), counterparty_id LIMIT 5")
def worst_counterparties(spark, sf_dir):
    d = marked(spark, sf_dir).groupBy("counterparty_id").agg(F.count("*").alias("n_fills"), F.avg("markout_3600s").alias("mean_markout"))
    return rounded(d.where("n_fills >= 20").orderBy("mean_markout", "counterparty_id").limit(5), 9)


@query(f"""WITH {TICKS_SQL}, b AS (SELECT *, (row_number() OVER (ORDER BY ts_ns, seq) - 1) // 50 AS block FROM ticks), q AS (SELECT *, first_value(mid) OVER (PARTITION BY block ORDER BY ts_ns, seq) AS quote FROM b),
h AS (SELECT *, CASE WHEN mid >= quote + 2e-4::DOUBLE + 5e-5::DOUBLE THEN 1 WHEN mid <= quote - 2e-4::DOUBLE - 5e-5::DOUBLE THEN -1 END AS sign FROM q), f AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY ts_ns, seq) AS n FROM h WHERE sign IS NOT NULL)
SELECT block, seq, ts_ns, sign, round(quote + sign * 2e-4, 6) AS price FROM f WHERE n = 1""")
def lp_pickoffs(spark, sf_dir):
    return rounded(synthetic.pickoffs(ticks(spark, sf_dir), refresh_ticks=50, slice_ns=SLICE))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """features_core with label and ts_ns, of fills whose label is known."""
    known = labelled(spark, sf_dir).select("fill_id", "ts_ns", "label").where("label >= 0")
    return features_core(spark, sf_dir).join(known, "fill_id")


@query(prepared=True)
def logreg_scores(spark, sf_dir):
    """Out-of-fold scores of a logistic model on purged folds."""
    f = fills(spark, sf_dir)
    data = features.build_features(labelled(spark, sf_dir).drop("price").join(f.select("fill_id", "price"), "fill_id"), ticks(spark, sf_dir), None, SHORT, LONG, H, slice_ns=SLICE)
    columns = ["obi", "micro_dev", "vol_short", "cp_toxic_rate_hist"]
    found = folds.fit(features.select_matrix(data, columns), splits.purged_kfold(f, H, 3), [columns], every=False)
    return found.scores().select(F.col("key").alias("fill_id"), "fold", "label", "score")


_ALL_KNOWN = " AND ".join(f"{c} IS NOT NULL" for c in features.CORE)


@query(
    f"""WITH RECURSIVE feats AS ({_FEATURES}), lab AS ({_TRIPLE} SELECT fill_id, label FROM labelled), roles AS ({_WALK}),
kept AS (SELECT feats.*, label FROM feats JOIN lab USING (fill_id) WHERE label >= 0 AND {_ALL_KNOWN}),
long AS (SELECT fill_id, label, feature, v FROM kept UNPIVOT (v FOR feature IN ({', '.join(features.CORE)}))),
used AS (SELECT fold, role, feature, label AS y, v FROM long JOIN roles USING (fill_id)),
scale AS (SELECT fold, feature, avg(v) AS m, stddev_pop(v) AS sd FROM used WHERE role = 'train' GROUP BY ALL HAVING min(y) < max(y)),
z AS (SELECT fold, role, feature, y, (v - m) / CASE WHEN sd > 1e-15 * abs(m) THEN sd ELSE 1 END AS z FROM used JOIN scale USING (fold, feature)),
newton AS (SELECT fold, feature, 0 AS it, 0::DOUBLE AS b0, 0::DOUBLE AS b1 FROM scale UNION ALL
  SELECT fold, feature, it + 1, b0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (
    SELECT fold, feature, any_value(it) AS it, any_value(b0) AS b0, any_value(b1) AS b1, sum(p - y) AS g0, sum((p - y) * z) + any_value(b1) AS g1,
      sum(p * (1 - p)) AS h00, sum(p * (1 - p) * z) AS h01, sum(p * (1 - p) * z * z) + 1 AS h11
    FROM (SELECT n.*, z.z, z.y, 1 / (1 + exp(-(n.b0 + n.b1 * z.z))) AS p FROM newton n JOIN z ON n.fold = z.fold AND n.feature = z.feature AND z.role = 'train' WHERE n.it < 12) GROUP BY fold, feature)),
scored AS (SELECT z.fold, z.feature, z.y, 1 / (1 + exp(-(b0 + b1 * z.z))) AS p FROM z JOIN newton n ON n.fold = z.fold AND n.feature = z.feature AND n.it = 12 WHERE z.role = 'test'),
ranked AS (SELECT *, rank() OVER (PARTITION BY fold, feature ORDER BY p) + (count(*) OVER (PARTITION BY fold, feature, p) - 1) / 2::DOUBLE AS rk FROM scored),
per AS (SELECT fold, feature, (sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2::DOUBLE) / (sum(y) * (count(*) - sum(y))) AS auc, 1 - avg((p - y) * (p - y)) / (avg(y) * (1 - avg(y))) AS skill FROM ranked GROUP BY ALL HAVING min(y) < max(y))
SELECT feature, {r('avg(auc)')} AS auc, {r('avg(skill)')} AS brier_skill, {r('min(auc)')} AS auc_min FROM (SELECT unnest([{', '.join(f"'{c}'" for c in features.CORE)}]) AS feature) LEFT JOIN per USING (feature) GROUP BY 1""",
    prepared=True,
)
def feature_scores(spark, sf_dir):
    """Each feature alone, on walk-forward folds."""
    return rounded(folds.univariate_scores(examples(spark, sf_dir), splits.walk_forward(fills(spark, sf_dir), H), features.CORE))


@query(prepared=True)
def selected_features(spark, sf_dir):
    """Features chosen one after the other by the mean area under the curve, and that area after each."""
    found = folds.forward_select(examples(spark, sf_dir), splits.walk_forward(fills(spark, sf_dir), H), features.CORE, metric="auc", floor=0.0, gain=0.0005)
    return rounded(spark.createDataFrame([(i, c, v) for i, (c, v) in enumerate(found.history, 1)], "step int, feature string, auc double"))


@query(prepared=True)
def calibrated_scores(spark, sf_dir):
    """Out-of-fold scores on walk-forward folds: three members a fold, each with a sigmoid fitted on rows it has not seen."""
    found = folds.cross_validate(examples(spark, sf_dir), splits.walk_forward(fills(spark, sf_dir), H), list(features.CORE), calibrate=True, slice_ns=SLICE)
    return rounded(found.scores, 9)


@query(prepared=True)
def fold_summary(spark, sf_dir):
    """Mean, deviation and range of the folds' metrics."""
    found = folds.cross_validate(examples(spark, sf_dir), splits.walk_forward(fills(spark, sf_dir), H), list(features.CORE))
    return rounded(folds.summarize(found.folds))


@query(prepared=True)
def toxicity_report(spark, sf_dir):
    """One call from ticks and fills to the verdict."""
    settings = report.Settings(horizons=HORIZONS, label_horizon=H, bucket_volume=BUCKET_VOLUME, vpin_window=10, short_seconds=SHORT, long_seconds=LONG, slice_ns=SLICE)
    return rounded(report.analyse(ticks(spark, sf_dir), fills(spark, sf_dir), settings).summary)


@query(prepared=True)
def tree_scores(spark, sf_dir):
    """Probabilities of boosted trees by their exported nodes, and how far they are from the fitted model's own."""
    known = labelled(spark, sf_dir).select("fill_id", "label").where("label >= 0")
    columns = ["spread", "obi", "rv_short", "vol_short", "dt_last_tick", "size_rel_vol"]
    data = written(featured(spark, sf_dir).select("fill_id", *columns).join(known, "fill_id"), "examples")
    fitted = learn.fit_trees(data, columns, trees=20)
    own = fitted.transform(data).withColumn("own", vector_to_array("probability")[1])
    scored_rows = export.exported(fitted).score(own, "score")
    return scored_rows.select("fill_id", "label", "score", F.abs(F.col("score") - F.col("own")).alias("apart"))


@query(prepared=True)
def suggested_labels(spark, sf_dir):
    return rounded(labels.suggested_labels(fills(spark, sf_dir), ticks(spark, sf_dir), H, slice_ns=SLICE), 9)


@query()
def stream_vpin(spark, sf_dir):
    """The realtime engine over the ticks as a file stream; one row a closed bucket."""
    base = scratch_path(spark, "stream")
    t = ticks(spark, sf_dir).withColumn("symbol", F.lit("EURUSD"))
    in_order(t, ["ts_ns", "seq"], f"{base}/in", 4)
    return streamed(engine.stream(file_stream(spark, t, f"{base}/in"), engine.Settings(BUCKET_VOLUME, window=10)), base)


def file_stream(spark: SparkSession, like: DataFrame, path: str, files: int = 1) -> DataFrame:
    """The files of a folder as a stream, the oldest first, so many a trigger."""
    return spark.readStream.schema(like.schema).option("latestFirst", "false").option("maxFilesPerTrigger", files).parquet(path)


def streamed(out: DataFrame, base: str) -> DataFrame:
    """Runs a streaming query over all that its source has now; returns what it wrote."""
    query = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{base}/out")


def in_order(df: DataFrame, by: list[str], path: str, files: int = 6) -> None:
    """Writes ``df`` as files in the order of time, one after the other, so that a stream reads them in that order."""
    parts = df.repartitionByRange(files, *by).withColumn("_file", F.spark_partition_id())
    parts = written(parts, "parts")
    for k in range(files):
        parts.where(F.col("_file") == k).drop("_file").coalesce(1).write.mode("append").parquet(path)


@query(_FEATURES, prepared=True)
def stream_features(spark, sf_dir):
    """features_core's rows, from live features over a stream of ticks and fills."""
    base = scratch_path(spark, "stream")
    symbol = F.lit("EURUSD").alias("symbol")
    events = live.ticks_and_fills(ticks(spark, sf_dir).select("*", symbol), fills(spark, sf_dir).select("*", symbol))
    in_order(events, ["ts_ns"], f"{base}/in")
    d = streamed(live.feature_stream(file_stream(spark, events, f"{base}/in"), SHORT, LONG), base)
    nine = ("rv_short", "rv_long", "tick_rate", "spread_mean")
    return d.select("fill_id", *[(F.round(c, 9 if c in nine else 6) + F.lit(0.0)).alias(c) for c in features.CORE])


@query(_history(f"ORDER BY ts_ns RANGE BETWEEN UNBOUNDED PRECEDING AND {seconds(H)} PRECEDING"), prepared=True)
def stream_cp_history(spark, sf_dir):
    """cp_history_delayed's rows, from live history over a stream of fills and of their labels an hour later."""
    base = scratch_path(spark, "stream")
    known = written(labelled(spark, sf_dir).select("counterparty_id", "fill_id", "ts_ns", "label"), "labelled")
    events = live.fills_and_labels(known, known, H)
    in_order(events, ["event_time"], f"{base}/in")
    d = streamed(live.history_stream(file_stream(spark, events, f"{base}/in")), base)
    return rounded(d.select("fill_id", "cp_fill_count", "cp_toxic_rate_hist"))


# Indicators on daily bars


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.daily(spark, sf_dir)


def _last(n: int) -> str:
    return f"(ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query(f"WITH {DAILY_SQL} SELECT day, {r(f'CASE WHEN count(*) OVER {_last(20)} >= 20 THEN avg(close) OVER {_last(20)} END')} AS sma_20 FROM daily")
def sma(spark, sf_dir):
    return rounded(indicators.sma(daily(spark, sf_dir), 20).select("day", "sma_20"))


def _ema(source: str, column: str, span: int, name: str) -> str:
    return f"""{name} AS (WITH RECURSIVE w(i, num, den) AS (SELECT i, {column}::DOUBLE, 1.0::DOUBLE FROM {source} WHERE i = 1 UNION ALL SELECT s.i, w.num * (1 - 2::DOUBLE / {span + 1}) + s.{column}, w.den * (1 - 2::DOUBLE / {span + 1}) + 1 FROM w JOIN {source} s ON s.i = w.i + 1) SELECT i, num / den AS e FROM w)"""


@query(f"WITH {DAILY_SQL}, num AS (SELECT *, row_number() OVER (ORDER BY day) AS i FROM daily), {_ema('num', 'close', 12, 'ef')}, {_ema('num', 'close', 27, 'es')}, line AS (SELECT num.i, day, ef.e - es.e AS macd FROM num JOIN ef USING (i) JOIN es USING (i)), {_ema('line', 'macd', 9, 'sg')} SELECT day, {r('macd', 4)} AS macd, {r('e', 4)} AS macd_signal, {r('macd - e', 4)} AS macd_histogram FROM line JOIN sg USING (i)")
def macd(spark, sf_dir):
    return rounded(indicators.macd(daily(spark, sf_dir)).select("day", "macd", "macd_signal", "macd_histogram"), 4)


_BB = f"WITH {DAILY_SQL}, b AS (SELECT day, close, CASE WHEN count(*) OVER w >= 20 THEN avg(close) OVER w END AS m, stddev_samp(close) OVER w AS s FROM daily WINDOW w AS {_last(20)})"


@query(_BB + f" SELECT day, {r('m', 4)} AS bb_mid, {r('m + 2 * s', 4)} AS bb_upper, {r('m - 2 * s', 4)} AS bb_lower, CASE WHEN close < m - 2 * s THEN 1 WHEN close > m + 2 * s THEN -1 ELSE 0 END AS bb_signal FROM b")
def bollinger(spark, sf_dir):
    return rounded(indicators.bollinger(daily(spark, sf_dir)).select("day", "bb_mid", "bb_upper", "bb_lower", "bb_signal"), 4)


_RSI = f"WITH {DAILY_SQL}, c AS (SELECT day, close, coalesce(close - lag(close) OVER (ORDER BY day), 0) AS d FROM daily), u AS (SELECT *, sum(greatest(d, 0)) OVER w AS up, sum(greatest(-d, 0)) OVER w AS dn, count(*) OVER w AS n FROM c WINDOW w AS {_last(14)}), rs AS (SELECT day, close, CASE WHEN n >= 14 THEN CASE WHEN dn > 0 THEN 100 - 100 / (1 + up / dn) WHEN up > 0 THEN 100 END END AS rsi FROM u)"


@query(_RSI + f" SELECT day, {r('rsi', 4)} AS rsi, CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 ELSE 0 END AS rsi_signal FROM rs")
def rsi(spark, sf_dir):
    return rounded(indicators.rsi(daily(spark, sf_dir)).select("day", "rsi", indicators.rsi_signal().alias("rsi_signal")), 4)


@query(_BB + ", a AS (SELECT day, CASE WHEN close < m - 2 * s THEN 1 WHEN close > m + 2 * s THEN -1 ELSE 0 END AS x FROM b), " + _RSI.removeprefix(f"WITH {DAILY_SQL}, ") + ", z AS (SELECT day, CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 ELSE 0 END AS y FROM rs) SELECT day, CASE WHEN x = y AND x <> 0 THEN 3 * x ELSE 0 END AS position FROM a JOIN z USING (day)")
def rsi_bollinger(spark, sf_dir):
    d = indicators.bollinger(indicators.rsi(daily(spark, sf_dir)))
    return d.select("day", indicators.confluence(F.col("bb_signal"), indicators.rsi_signal(), 3).alias("position"))


_TEST = f"WITH {DAILY_SQL}, s AS (SELECT day, close, CASE WHEN close > CASE WHEN count(*) OVER w >= 20 THEN avg(close) OVER w END THEN 1 ELSE -1 END AS sig FROM daily WINDOW w AS {_last(20)}), c AS (SELECT day, close / lag(close) OVER (ORDER BY day) - 1 AS ch, lag(sig) OVER (ORDER BY day) AS held FROM s)"


@query(_TEST + f" SELECT day, {r('CASE WHEN ch IS NOT NULL THEN product(1 + coalesce(ch, 0)) OVER w - 1 END', 5)} AS asset_return, {r('CASE WHEN ch IS NOT NULL THEN product(1 + coalesce(ch * held, 0)) OVER w - 1 END', 5)} AS strategy_return FROM c WINDOW w AS (ORDER BY day)")
def backtest(spark, sf_dir):
    d = indicators.sma(daily(spark, sf_dir), 20)
    d = d.withColumn("signal", indicators.signal(F.col("close") > F.col("sma_20")))
    return rounded(indicators.backtest(d, "signal").select("day", "asset_return", "strategy_return"), 5)


_FAST, _SLOW = (3, 5, 10), (5, 10, 20)


@query(f"WITH {DAILY_SQL}, m AS (SELECT day, close / lag(close) OVER (ORDER BY day) - 1 AS ch, " + ", ".join(f"CASE WHEN row_number() OVER (ORDER BY day) >= {n} THEN avg(close) OVER {_last(n)} END AS a{n}" for n in (3, 5, 10, 20)) + " FROM daily), x AS (" + " UNION ALL ".join(f"SELECT day, ch, {f} AS fast, {s} AS slow, CASE WHEN a{f} > a{s} THEN 1 ELSE -1 END AS sig FROM m" for f in _FAST for s in _SLOW if f < s) + f"), y AS (SELECT fast, slow, 1 + coalesce(ch * lag(sig) OVER (PARTITION BY fast, slow ORDER BY day), 0) AS f FROM x) SELECT fast, slow, {r('product(f) - 1', 5)} AS final_return FROM y GROUP BY 1, 2")
def ma_sweep(spark, sf_dir):
    return rounded(indicators.crossover_sweep(daily(spark, sf_dir), _FAST, _SLOW), 5)


@query(f"WITH {DAILY_SQL} SELECT day, {r(f'revenue / avg(revenue) OVER {_last(365)}')} AS puell FROM daily")
def puell(spark, sf_dir):
    return rounded(indicators.puell(daily(spark, sf_dir)).select("day", "puell"))


@query(f"WITH {DAILY_SQL}, p AS (SELECT revenue / avg(revenue) OVER {_last(365)} AS puell FROM daily) SELECT {r('avg(puell)')} AS mean, {r('quantile_cont(puell, 0.5)')} AS median, {r('min(puell)')} AS min, {r('max(puell)')} AS max FROM p")
def puell_summary(spark, sf_dir):
    return rounded(indicators.distribution(indicators.puell(daily(spark, sf_dir)), "puell"))


