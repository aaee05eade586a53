"""Tail probabilities of the normal, Student and chi-squared distributions.

Spark has no ``erf``: the normal distribution that a test needs for every distinct value
is column arithmetic; the helpers inside pandas UDFs see one row per feature.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


_NEAR = 2.5  # up to here a power series, beyond a continued fraction
_LOG_ROOT = "0.9189385332046727e0"  # ln(sqrt(2 pi))


def log_cdf_texts(a: str, q: str) -> tuple[str, str]:
    """SQL texts of ln P(Z <= a) and ln P(Z > a) for a >= 0; ``q`` names a squared.

    Plain arithmetic that Spark and DuckDB both take: the series a * (1 + q/3 * (1 + q/5 *
    ...)) of the distribution around 0, and the fraction a + 1/(a + 2/(a + ...)) of the tail.
    """
    near, far = f"least({q}, {_NEAR * _NEAR}e0)", f"greatest({a}, {_NEAR}e0)"
    series = "1e0"
    for k in range(32, 0, -1):
        series = f"(1e0 + {near} / {2 * k + 1}e0 * {series})"
    fraction = far
    for k in range(72, 0, -1):
        fraction = f"({far} + {k}e0 / {fraction})"
    middle = f"({a} * exp(-{near} / 2e0 - {_LOG_ROOT}) * {series})"
    tail = f"(-{q} / 2e0 - {_LOG_ROOT} - ln({fraction}))"
    return (f"CASE WHEN {a} <= {_NEAR}e0 THEN ln(0.5e0 + {middle}) ELSE ln(1e0 - exp({tail})) END",
            f"CASE WHEN {a} <= {_NEAR}e0 THEN ln(0.5e0 - {middle}) ELSE {tail} END")


def two_sided_normal(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def two_sided_student(t: float, dof: float) -> float:
    return incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        for k in range(1, 10000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-16:
                break
        return 1.0 - front * total
    b, c = x + 1 - a, 1e300
    d = h = 1.0 / b
    for k in range(1, 10000):
        step = -k * (k - a)
        b += 2
        d = 1.0 / (step * d + b)
        c = b + step / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def chi2_tail(stat: float, dof: float) -> float:
    return upper_gamma(dof / 2, stat / 2)


def _each(fn, *columns: pd.Series) -> pd.Series:
    rows = zip(*(c.to_numpy(dtype=float, na_value=np.nan) for c in columns))
    return pd.Series([None if any(map(math.isnan, r)) else fn(*r) for r in rows], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return _each(two_sided_normal, z)


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _each(two_sided_student, t, dof)


@F.pandas_udf(DoubleType())
def chi2_p(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return _each(chi2_tail, stat, dof)
