"""Scalar functions that Spark lacks or that the domain fixes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship

# Coefficients of a published rational approximation of erfc (Cody 1969), three ranges.
_SMALL_P = (3.1611237438705656, 113.864154151050156, 377.485237685302021, 3209.37758913846947, 0.185777706184603153)
_SMALL_Q = (23.6012909523441209, 244.024637934444173, 1282.61652607737228, 2844.23683343917062)
_MIDDLE_P = (0.564188496988670089, 8.88314979438837594, 66.1191906371416295, 298.635138197400131, 881.95222124176909, 1712.04761263407058, 2051.07837782607147, 1230.33935479799725, 2.15311535474403846e-8)
_MIDDLE_Q = (15.7449261107098347, 117.693950891312499, 537.181101862009858, 1621.38957456669019, 3290.79923573345963, 4362.61909014324716, 3439.36767414372164, 1230.33935480374942)
_LARGE_P = (0.305326634961232344, 0.360344899949804439, 0.125781726111229246, 0.0160837851487422766, 0.000658749161529837803, 0.0163153871373020978)
_LARGE_Q = (2.56852019228982242, 1.87295284992346725, 0.527905102951428412, 0.0605183413124413191, 0.00233520497626869185)
_ONE_OVER_SQRT_PI = 0.564189583547756287


def _chain(x: str, start: str, first: tuple[float, ...]) -> str:
    """Horner's scheme as SQL text."""
    out = start
    for c in first:
        out = f"(({out}) * ({x}) + cast({c!r} AS DOUBLE))"
    return out


def norm_cdf_sql(z: str) -> str:
    """The standard normal distribution function of an SQL expression, as SQL that Spark and other engines read alike."""
    y = f"abs(({z}) / sqrt(cast(2 AS DOUBLE)))"
    t = f"({y} * {y})"
    small = f"({z}) / sqrt(cast(2 AS DOUBLE)) * {_chain(t, f'cast({_SMALL_P[4]!r} AS DOUBLE)', _SMALL_P[:4])} / {_chain(t, 'cast(1.0 AS DOUBLE)', _SMALL_Q)}"
    middle = f"exp(-{t}) * {_chain(y, f'cast({_MIDDLE_P[8]!r} AS DOUBLE)', _MIDDLE_P[:8])} / {_chain(y, 'cast(1.0 AS DOUBLE)', _MIDDLE_Q)}"
    u = f"(cast(1.0 AS DOUBLE) / greatest({t}, cast(1e-300 AS DOUBLE)))"
    large = f"exp(-{t}) / greatest({y}, cast(1e-150 AS DOUBLE)) * (cast({_ONE_OVER_SQRT_PI!r} AS DOUBLE) - {u} * {_chain(u, f'cast({_LARGE_P[5]!r} AS DOUBLE)', _LARGE_P[:5])} / {_chain(u, 'cast(1.0 AS DOUBLE)', _LARGE_Q)})"
    tail = f"(CASE WHEN {y} <= 4 THEN {middle} WHEN {y} < 26.5 THEN {large} ELSE cast(0.0 AS DOUBLE) END)"
    return f"(CASE WHEN ({z}) IS NULL THEN NULL WHEN {y} <= cast(0.46875 AS DOUBLE) THEN cast(0.5 AS DOUBLE) * (1 + {small}) WHEN ({z}) > 0 THEN 1 - cast(0.5 AS DOUBLE) * {tail} ELSE cast(0.5 AS DOUBLE) * {tail} END)"


def norm_cdf(z: str) -> Column:
    """The standard normal distribution function of a column or SQL expression."""
    return F.expr(norm_cdf_sql(z))


def _incomplete_beta(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction, evaluated with Lentz's method."""
    x = np.asarray(x, float)
    flip = x > (a + 1) / (a + b + 2)
    p, q = np.where(flip, b, a), np.where(flip, a, b)
    v = np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + p * np.log(v) + q * np.log1p(-v)) / p
    tiny = 1e-300
    num, den = np.ones_like(v), np.where(np.abs(1 - (p + q) * v / (p + 1)) < tiny, tiny, 1 - (p + q) * v / (p + 1))
    den = 1 / den
    value = den.copy()
    for m in range(1, 500):
        for coefficient in (m * (q - m) * v / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * v / ((p + 2 * m) * (p + 2 * m + 1))):
            den = 1 + coefficient * den
            den = 1 / np.where(np.abs(den) < tiny, tiny, den)
            num = 1 + coefficient / num
            num = np.where(np.abs(num) < tiny, tiny, num)
            step = den * num
            value = value * step
        if np.nanmax(np.abs(step - 1), initial=0) < 1e-15:
            break
    out = front * value
    out = np.where(v <= 0, 0.0, out)
    return np.where(flip, 1 - out, out)


def student_t_cdf_array(t: np.ndarray, df: float) -> np.ndarray:
    """Student's t distribution function; with df of 0 or less the normal one."""
    t = np.asarray(t, float)
    if df <= 0:
        return np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in t.ravel()]).reshape(t.shape)
    half = 0.5 * _incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return np.where(t >= 0, 1 - half, half)


def student_t_cdf(t: Column, df: float) -> Column:
    """Student's t distribution function with a fixed df, vectorised over Arrow batches."""
    if (session := SparkSession.getActiveSession()) is not None:
        ship(session)

    @F.pandas_udf("double")
    def cdf(x: pd.Series) -> pd.Series:
        return pd.Series(np.where(x.isna(), np.nan, student_t_cdf_array(x.fillna(0.0).to_numpy(), df)))

    return F.nanvl(cdf(t), F.lit(None).cast("double"))


def register(spark: SparkSession) -> None:
    """norm_cdf(z) and student_t_cdf(t, df) for SQL users; the first is an expression that the JVM evaluates."""
    ship(spark)

    @F.pandas_udf("double")
    def t_cdf(x: pd.Series, df: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        for value in df.dropna().unique():
            rows = (df == value) & x.notna()
            out[rows] = student_t_cdf_array(x[rows].to_numpy(np.float64), float(value))
        return pd.Series(out)

    spark.udf.register("student_t_cdf", t_cdf)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION norm_cdf(z DOUBLE) RETURNS DOUBLE RETURN {norm_cdf_sql('z')}")


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def required_spread(alpha: float, p: Column) -> Column:
    return 2 * F.lit(alpha) * F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))


def session_label(hour: Column) -> Column:
    """Trading session of an hour of day (UTC); null gives unknown."""
    return (
        F.when(hour.isNull(), "unknown")
        .when((hour >= 12) & (hour < 17), "london_ny_overlap")
        .when((hour >= 7) & (hour < 12), "london")
        .when((hour >= 17) & (hour < 21), "ny_afternoon")
        .otherwise("asia")
    )


def point_value(symbol: str) -> float:
    """Price of one point of a quote: a thousandth for yen and metals, else a hundred-thousandth."""
    return 1e-3 if any(x in symbol.upper() for x in ("JPY", "XAU", "XAG")) else 1e-5


def side_sign(side: Column) -> Column:
    """1 for buys, -1 for sells, of names (buy, b, sell, s in any case) or numbers (0 and above is buy); else null."""
    name = F.lower(F.trim(side.cast("string")))
    number = F.try_to_number(name, F.lit("S999999999.999999"))
    return F.when(name.isin("buy", "b"), 1).when(name.isin("sell", "s"), -1).when(number >= 0, 1).when(number < 0, -1).cast("int")
