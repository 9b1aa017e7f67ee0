"""Unit-root tests and fractional orders against plain least squares over the whole series."""

import math

import numpy as np
import pytest

from flowtide.operators import features, stationarity


def plain_test(y, max_lag=None):
    """(lag, statistic) by one least-squares fit for every lag, written from the definition."""
    y = np.asarray(y, float)
    y = y[~np.isnan(y)]
    if len(y) < 20 or len(set(y)) < 3:
        return None
    lags = min(len(y) // 2 - 2, math.ceil(12 * (len(y) / 100) ** 0.25) if max_lag is None else max_lag)

    def fit(lag, first):
        dy = np.diff(y)
        rows = range(first, len(dy))
        x = np.array([[1.0, y[t], *(dy[t - k] for k in range(1, lag + 1))] for t in rows])
        target = dy[first:]
        beta, *_ = np.linalg.lstsq(x, target, rcond=None)
        ssr = float(((target - x @ beta) ** 2).sum())
        return x, beta, ssr, len(target)

    scores = []
    for lag in range(lags + 1):
        _, _, ssr, n = fit(lag, lags)
        scores.append(n * math.log(ssr / n) + 2 * (lag + 2))
    lag = int(np.argmin(scores))
    x, beta, ssr, n = fit(lag, lag)
    error = math.sqrt(ssr / (n - lag - 2) * np.linalg.inv(x.T @ x)[1, 1])
    return lag, beta[1] / error


def plain_diff(x, d):
    weights = [1.0] if d == 0 else features.ffd_weights(d, 1e-3)
    out = np.full(len(x), np.nan)
    for t in range(len(weights) - 1, len(x)):
        out[t] = np.dot(x[t - len(weights) + 1 : t + 1], weights)
    return out


def series(n, seed=5):
    rng = np.random.default_rng(seed)
    noise = rng.normal(size=(3, n))
    walk = 1.1 + 1e-4 * np.cumsum(noise[0])
    settled = np.zeros(n)
    for t in range(2, n):
        settled[t] = 0.5 * settled[t - 1] + 0.2 * settled[t - 2] + noise[1][t]
    return {"walk": walk, "settled": settled, "gaps": np.where(rng.random(n) < 0.1, np.nan, np.cumsum(noise[2])), "flat": np.ones(n), "two": np.arange(n) % 2.0}


def frame(spark, columns, shuffle=True):
    names = list(columns)
    rows = [(i * 30_000_000_000, i, *(None if math.isnan(columns[c][i]) else float(columns[c][i]) for c in names)) for i in range(len(columns[names[0]]))]
    df = spark.createDataFrame(rows, "ts_ns long, seq long, " + ", ".join(f"`{c}` double" for c in names))
    return df.repartition(5) if shuffle else df


@pytest.fixture
def small_parts(monkeypatch):
    # Part lengths are chosen on the driver, so the tasks see these too.
    monkeypatch.setattr(stationarity, "PART_ROWS", 64)


def test_report_equals_least_squares(spark, small_parts):
    data = series(700)
    found = stationarity.stationarity(frame(spark, data), list(data))
    for name, values in data.items():
        want, got = plain_test(values), found[name]
        assert got.n == int((~np.isnan(values)).sum())
        if want is None:
            assert math.isnan(got.statistic) and math.isnan(got.p) and not got.stationary
        else:
            assert got.lag == want[0] and got.statistic == pytest.approx(want[1], rel=1e-7)
    assert found["settled"].stationary and not found["walk"].stationary
    fixed = stationarity.stationarity(frame(spark, data), ["settled"], max_lag=3)["settled"]
    assert (fixed.lag, fixed.statistic) == (plain_test(data["settled"], 3)[0], pytest.approx(plain_test(data["settled"], 3)[1], rel=1e-8))


def test_p_values_of_the_published_surface():
    # Critical values of the test with a constant, in large samples.
    for statistic, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert stationarity.p_value(statistic) == pytest.approx(p, abs=0.001)
    assert stationarity.p_value(3.0) == 1.0 and stationarity.p_value(-20.0) == 0.0 and math.isnan(stationarity.p_value(math.nan))
    falling = [stationarity.p_value(x) for x in np.linspace(-18, 2.7, 60)]
    assert falling == sorted(falling)


def test_report_table_and_short_series(spark):
    table = stationarity.stationarity_report(frame(spark, {"a.b": np.arange(15.0)}), ["a.b"]).collect()
    assert [tuple(r) for r in table] == [("a.b", 15, None, None, None, False)]
    empty = spark.createDataFrame([], "ts_ns long, seq long, x double")
    assert stationarity.stationarity(empty, ["x"])["x"].n == 0
    assert stationarity.min_ffd_order(empty, "x", [0.0, 0.5]).where("n_obs = 0 AND adf_stat IS NULL").count() == 2


@pytest.mark.parametrize("name", ["walk", "gaps", "late"])
def test_orders_equal_the_definition(spark, small_parts, name):
    data = series(500)
    data["late"] = np.where(np.arange(500) < 37, np.nan, data["walk"])  # no gap after its first value
    candidates = [0.0, 0.3, 0.6, 1.0]
    table = {r.d: r for r in stationarity.min_ffd_order(frame(spark, {name: data[name]}), name, candidates, least=1e-3).collect()}
    assert sorted(table) == candidates
    for d in candidates:
        y = plain_diff(data[name], d)
        want, got = plain_test(y), table[d]
        assert got.n_obs == int((~np.isnan(y)).sum())
        if want is None:
            assert got.adf_stat is None and got.stationary is False
        else:
            assert got.adf_stat == pytest.approx(want[1], rel=1e-6) and got.stationary == (got.adf_pvalue < 0.05)
        both = ~np.isnan(y)
        if both.sum() > 2:
            assert got.corr_with_level == pytest.approx(np.corrcoef(data[name][both], y[both])[0, 1], rel=1e-6)


def test_least_order_and_differenced_columns(spark, small_parts):
    data = series(500)
    df = frame(spark, {c: data[c] for c in ("walk", "settled")})
    wanted = next(d for d in stationarity.steps(0.1) if (t := plain_test(plain_diff(data["walk"], d))) and stationarity.p_value(t[1]) < 0.05)
    assert stationarity.find_min_d(df, "walk", least=1e-3) == wanted > 0
    out, orders = stationarity.add_fractional_differencing(df, ("walk", "settled", "absent"), least=1e-3)
    assert orders == {"walk": wanted, "settled": 0.0}
    rows = sorted(out.collect(), key=lambda r: r.seq)
    assert [r.settled_ffd for r in rows] == [r.settled for r in rows]
    y = plain_diff(data["walk"], wanted)
    assert all((r.walk_ffd is None) == math.isnan(v) and (r.walk_ffd is None or r.walk_ffd == pytest.approx(v, rel=1e-9, abs=1e-12)) for r, v in zip(rows, y))
    # Too few values to test leave the last order.
    assert stationarity.find_min_d(df.where("seq < 25"), "walk") == 1.0


def test_health_has_a_p_value_where_the_column_varies(spark):
    data = series(300)
    table = {r.feature: r for r in stationarity.health(frame(spark, data), list(data)).collect()}
    assert table["flat"].adf_pvalue is None and table["two"].adf_pvalue is None
    assert table["walk"].adf_pvalue == pytest.approx(stationarity.p_value(plain_test(data["walk"])[1]), rel=1e-6)
    assert table["gaps"].nan_rate == pytest.approx(np.isnan(data["gaps"]).mean())
