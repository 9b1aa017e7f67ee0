"""Known values of the scalar functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtide.functions import special


def test_norm_cdf_is_exact(spark):
    zs = [0.0, 1.0, -1.96, 3.0, -0.3, 0.5, -6.0, 8.5, -12.0, 40.0, -40.0]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", special.norm_cdf("z").alias("p")).collect()
    for r in rows:
        want = 0.5 * math.erfc(-r["z"] / math.sqrt(2))
        assert r["p"] == pytest.approx(want, rel=1e-12, abs=1e-300)
    assert spark.range(1).select(special.norm_cdf("cast(null AS double)").alias("p")).first()["p"] is None


def test_student_t_cdf():
    t = special.student_t_cdf_array
    assert t(np.array([0.0]), 3)[0] == 0.5
    assert t(np.array([1.0, -1.0]), 1) == pytest.approx([0.75, 0.25], abs=1e-12)
    assert t(np.array([2.0]), 5)[0] + t(np.array([-2.0]), 5)[0] == pytest.approx(1, abs=1e-12)
    assert 0.5 < t(np.array([1.5]), 0.25)[0] < 1
    assert t(np.array([1.0]), 0)[0] == pytest.approx(0.8413447460685429)


def test_sides_sessions_and_points(spark):
    rows = spark.createDataFrame([(x,) for x in ("buy", " B ", "Sell", "s", "1", "0", "-1", "-2.5", "x")], "s string")
    assert [r[0] for r in rows.select(special.side_sign(F.col("s"))).collect()] == [1, 1, -1, -1, 1, 1, -1, -1, None]
    hours = spark.createDataFrame([(h,) for h in (0, 7, 11, 12, 16, 17, 20, 21, None)], "h int")
    assert [r[0] for r in hours.select(special.session_label(F.col("h"))).collect()] == ["asia", "london", "london", "london_ny_overlap", "london_ny_overlap", "ny_afternoon", "ny_afternoon", "asia", "unknown"]
    assert (special.point_value("USDJPY"), special.point_value("EURUSD")) == (1e-3, 1e-5)


def test_sigmoid_does_not_overflow(spark):
    got = spark.createDataFrame([(0.0,), (800.0,), (-800.0,)], "x double").select(special.sigmoid(F.col("x"))).collect()
    assert [r[0] for r in got] == [0.5, 1.0, 0.0]


def test_functions_for_sql(spark):
    import math

    special.register(spark)
    rows = spark.sql("SELECT z, norm_cdf(z) AS n, student_t_cdf(z, df) AS t FROM VALUES (-2.0D, 1.0D), (0.5D, 1.0D), (0.5D, NULL), (NULL, 3.0D) AS v(z, df)").collect()
    assert [r.n is None for r in rows] == [False, False, False, True]
    for r in rows[:3]:
        assert abs(r.n - 0.5 * math.erfc(-r.z / math.sqrt(2))) < 1e-12
    # With one degree of freedom the distribution is Cauchy's.
    assert all(abs(r.t - (0.5 + math.atan(r.z) / math.pi)) < 1e-9 for r in rows[:2])
    assert all(r.t is None or math.isnan(r.t) for r in rows[2:])
