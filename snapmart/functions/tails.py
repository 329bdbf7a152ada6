"""Tail probabilities for test statistics.

Spark has no gamma or beta tail function. The numbers here are computed on
result rows of a test (one per column pair), never on table rows.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The functions travel to the executors by value, so the package itself need
# not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def gamma_tail(a: float, x: float) -> float:
    """Upper regularised incomplete gamma Q(a, x): series or continued fraction."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    b = x + 1 - a
    c = 1e300
    d = 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return scale * h


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b), by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_share(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_tail(stat: float, dof: float) -> float | None:
    """P(chi-square with ``dof`` > stat)."""
    if stat is None or dof is None or math.isnan(stat):
        return None
    return 1.0 if dof <= 0 else gamma_tail(dof / 2, stat / 2)


def t_two_sided(t: float, dof: float) -> float | None:
    """P(|T| > |t|) for Student's t."""
    if t is None or dof is None or math.isnan(t) or dof <= 0:
        return None
    if dof > 1e5:
        # The beta function's logarithms cancel for huge samples; the corrected
        # normal tail is exact to the order of 1 / dof^2.
        z = abs(t) * (1 - 1 / (4 * dof)) / math.sqrt(1 + t * t / (2 * dof))
        return math.erfc(z / math.sqrt(2))
    return beta_share(dof / 2, 0.5, dof / (dof + t * t))


@F.pandas_udf(T.DoubleType())
def chi2_p_value(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(s, d) for s, d in zip(stat, dof)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(s, d) for s, d in zip(t, dof)], dtype="float64")
