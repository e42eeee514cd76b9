"""Tail probabilities for the chi-square and Student t statistics.

scipy is not available, so the regularised incomplete gamma and beta
functions are evaluated here (series / continued fractions, the textbook
numerical methods).  They only ever run on the ONE result row of a test,
through an Arrow-batched pandas UDF.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPS = 1e-15
_TINY = 1e-300
_MAXIT = 10_000


def _gamma_p_series(a: float, x: float) -> float:
    term = total = 1.0 / a
    ap = a
    for _ in range(_MAXIT):
        ap += 1.0
        term *= x / ap
        total += term
        if abs(term) < abs(total) * _EPS:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gamma_q_cf(a: float, x: float) -> float:
    # modified Lentz evaluation of the continued fraction for Q(a, x)
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, _MAXIT):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = _TINY if abs(d) < _TINY else d
        c = b + an / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    if x < a + 1.0:
        return 1.0 - _gamma_p_series(a, x)
    return _gamma_q_cf(a, x)


def chi2_sf(x: float, dof: float) -> float:
    """P(X >= x) for X ~ chi-square(dof)."""
    if x is None or dof is None or dof <= 0 or math.isnan(x):
        return float("nan")
    return gamma_q(dof / 2.0, x / 2.0)


def _beta_cf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = _TINY if abs(d) < _TINY else d
    d = 1.0 / d
    h = d
    for m in range(1, _MAXIT):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1.0 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1.0 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1.0 - x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _beta_cf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _beta_cf(b, a, 1.0 - x) / b


def t_sf_two_sided(t: float, dof: float) -> float:
    """P(|T| >= |t|) for T ~ Student t(dof)."""
    if t is None or dof is None or dof <= 0 or math.isnan(t):
        return float("nan")
    return beta_inc(dof / 2.0, 0.5, dof / (dof + t * t))


# -- Arrow UDFs (used on one-row result frames only) -----------------------------

@F.pandas_udf(T.DoubleType())
def chi2_pvalue(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(float(a), float(b)) if pd.notna(a) and pd.notna(b) else None
                      for a, b in zip(x, dof)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_sf_two_sided(float(a), float(b)) if pd.notna(a) and pd.notna(b) else None
                      for a, b in zip(t, dof)], dtype="float64")
