"""Tail probabilities as vectorised functions; use them on aggregated rows only."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, evaluated step by step until it stands still."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d
    for m in range(1, 300):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + numerator * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + numerator / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    return h


def incomplete_beta(a, b, x) -> np.ndarray:
    """The regularised incomplete beta function."""
    a, b, x = (np.asarray(v, dtype="f8") for v in np.broadcast_arrays(a, b, x))
    x = np.clip(x, 0.0, 1.0)
    lgamma = np.vectorize(math.lgamma, otypes=["f8"])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x))
        low = x < (a + 1) / (a + b + 2)
        out = np.where(low, front * beta_fraction(a, b, x) / a, 1 - front * beta_fraction(b, a, 1 - x) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_two_sided(t, df) -> np.ndarray:
    t, df = np.asarray(t, "f8"), np.asarray(df, "f8")
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_upper(f, d1, d2) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, "f8") for v in (f, d1, d2))
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def normal_two_sided(z) -> np.ndarray:
    return np.vectorize(lambda v: math.erfc(abs(v) / math.sqrt(2)), otypes=["f8"])(np.asarray(z, "f8"))


def chi2_upper(x, df) -> np.ndarray:
    """The upper tail of chi squared: for each, the regularised incomplete gamma function by its series, or by its continued fraction where that is faster."""

    def one(x: float, a: float) -> float:
        if x <= 0:
            return 1.0
        front = math.exp(-x + a * math.log(x) - math.lgamma(a))
        if x < a + 1:
            term = total = 1 / a
            k = a
            while abs(term) > abs(total) * 1e-16:
                k += 1
                term *= x / k
                total += term
            return 1 - total * front
        tiny = 1e-300
        b = x + 1 - a
        c, d = 1 / tiny, 1 / b
        h = d
        for i in range(1, 1000):
            an = -i * (i - a)
            b += 2
            d = 1 / (an * d + b if abs(an * d + b) > tiny else tiny)
            c = b + an / c if abs(b + an / c) > tiny else tiny
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return front * h

    return np.vectorize(lambda v, n: one(v / 2, n / 2), otypes=["f8"])(np.asarray(x, "f8"), np.asarray(df, "f8"))


#: Fixed values of the published approximation: polynomials, from the constant up, of the two outer weights in 1 / sqrt(n), and of the mean and log deviation of the transformed statistic.
OUTER = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SHORT_SHIFT, SHORT_MEAN, SHORT_LOG_SD = (-2.273, 0.459), (0.5440, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322)
LONG_MEAN, LONG_LOG_SD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


def shapiro_wilk(values) -> tuple[float, float]:
    """W and p of the Shapiro-Wilk test for 3 to 5000 values, by Royston's approximation; NaN where values don't vary or are too few."""
    x = np.sort(np.asarray(values, "f8"))
    n = len(x)
    if n < 3 or x[-1] == x[0]:
        return math.nan, math.nan
    poly = lambda c, v: sum(k * v**i for i, k in enumerate(c))
    m = np.array([NormalDist().inv_cdf((i + 1 - 0.375) / (n + 0.25)) for i in range(n)])
    size, a = float(m @ m), m.copy()
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        outer = m[-1] / math.sqrt(size) + poly(OUTER, n**-0.5)
        if n > 5:
            second = m[-2] / math.sqrt(size) + poly(NEXT, n**-0.5)
            rest = (size - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * outer**2 - 2 * second**2)
            a = m / math.sqrt(rest)
            a[[1, -2]] = -second, second
        else:
            a = m / math.sqrt((size - 2 * m[-1] ** 2) / (1 - 2 * outer**2))
        a[[0, -1]] = -outer, outer
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    left = math.log(max(1 - w, 1e-300))
    if n <= 11:
        shift = poly(SHORT_SHIFT, n)
        if left >= shift:
            return w, 0.0
        z = (-math.log(shift - left) - poly(SHORT_MEAN, n)) / math.exp(poly(SHORT_LOG_SD, n))
    else:
        z = (left - poly(LONG_MEAN, math.log(n))) / math.exp(poly(LONG_LOG_SD, math.log(n)))
    return w, 0.5 * math.erfc(z / math.sqrt(2))


@F.pandas_udf(DoubleType())
def shapiro_p(values: pd.Series) -> pd.Series:
    """p of the Shapiro-Wilk test of each list of values; null where there is none."""
    p = [shapiro_wilk(v)[1] if v is not None else math.nan for v in values]
    return pd.Series(p).astype(object).where(~np.isnan(p), None)


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal value; null stays null."""
    return pd.Series(np.where(z.isna(), np.nan, normal_two_sided(z.fillna(0.0)))).where(z.notna().to_numpy(), None)


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation of n points; null with under 3 points or no correlation."""
    ok = (r.notna() & (n > 2)).to_numpy()
    rr, df = np.clip(r.fillna(0.0).to_numpy("f8"), -1, 1), np.maximum(n.fillna(3).to_numpy("f8") - 2, 1)
    t = rr * np.sqrt(df / np.maximum(1 - rr * rr, 1e-300))
    return pd.Series(np.where(ok, t_two_sided(t, df), np.nan)).where(ok, None)
