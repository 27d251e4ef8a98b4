"""Student's t and normal probabilities, exact to double precision, for tables of results.

Spark has no such function; the rows are one per configuration, so a pandas UDF
costs nothing. The incomplete beta function is evaluated by its continued
fraction (Lentz's method), quantiles by bisection on it.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function of x in [0, 1]."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    c, total = 1.0, d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * total


def two_sided(t: float, freedom: float) -> float:
    """Probability of a t value at least as far from 0; NaN where there is no degree of freedom."""
    if t is None or freedom is None or freedom < 1 or t != t or freedom != freedom:
        return float("nan")
    return 0.0 if math.isinf(t) else incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t))


def quantile(freedom: float, level: float = 0.95) -> float:
    """The t value that leaves 1 - ``level`` outside on both sides."""
    if freedom is None or freedom < 1 or freedom != freedom:
        return float("nan")
    low, high = 0.0, 1.0
    while two_sided(high, freedom) > 1 - level:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if two_sided(mid, freedom) > 1 - level else (low, mid)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def _p_value(t: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series([two_sided(a, b) for a, b in zip(t, freedom, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _quantile(freedom: pd.Series) -> pd.Series:
    known = {f: quantile(f) for f in freedom.unique()}
    return freedom.map(known).astype("float64")


@F.pandas_udf(T.DoubleType())
def _normal(z: pd.Series) -> pd.Series:
    return pd.Series([math.erfc(abs(x) / math.sqrt(2)) if x is not None and x == x else float("nan") for x in z], dtype="float64")


def _or_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def t_p_value(t: Column, freedom: Column) -> Column:
    """Two-sided p value of a t value; null where it isn't defined."""
    return _or_null(_p_value(t.cast("double"), freedom.cast("double")))


def t_quantile(freedom: Column) -> Column:
    """Half-width of the 95 % interval in standard errors; null below one degree of freedom."""
    return _or_null(_quantile(freedom.cast("double")))


def normal_p_value(z: Column) -> Column:
    """Two-sided p value of a normal deviate; null where it isn't defined."""
    return _or_null(_normal(z.cast("double")))
