"""Small numeric helpers for result tables of a few rows per feature."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def _p_value(r: float, n: float) -> float:
    if pd.isna(r) or pd.isna(n) or n < 3:
        return np.nan
    df = n - 2.0
    rest = max(0.0, 1.0 - r * r)
    return beta_inc(df / 2.0, 0.5, rest) if rest > 0 else 0.0


def _p_values(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([_p_value(a, b) for a, b in zip(r, n)]).astype("float64")


def correlation_p(r: str, n: str) -> Column:
    """Two-sided p-value of a correlation from n pairs (Student t with n-2 degrees)."""
    return F.pandas_udf(_p_values, "double")(F.col(r), F.col(n))
