"""Tail functions that Spark lacks, as NumPy code for pandas UDFs and the driver.

The regularised incomplete gamma and beta functions use their standard series
and continued-fraction expansions, vectorised over the batch.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def digamma(x):
    """Recurrence up to 6, then the asymptotic series."""
    x = np.array(x, dtype=float, ndmin=1, copy=True)
    out = np.zeros_like(x)
    while np.any(x < 6):
        low = x < 6
        out[low] -= 1.0 / x[low]
        x[low] += 1.0
    inv = 1.0 / x
    inv2 = inv * inv
    out += np.log(x) - 0.5 * inv - inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 * (1 / 240 - inv2 / 132))))
    return out if out.size > 1 else float(out[0])


def lgamma(x: float) -> float:
    return math.lgamma(x)


def gamma_p(a: float, x):
    """Lower regularised incomplete gamma."""
    x = np.atleast_1d(np.asarray(x, dtype=float))
    out = np.zeros_like(x)
    pos = x > 0
    series = pos & (x < a + 1)
    if series.any():
        xs = x[series]
        term = np.full_like(xs, 1.0 / a)
        acc = term.copy()
        n = a
        for _ in range(1000):
            n += 1
            term = term * xs / n
            acc += term
            if np.all(np.abs(term) < np.abs(acc) * 1e-16):
                break
        out[series] = acc * np.exp(-xs + a * np.log(xs) - math.lgamma(a))
    frac = pos & ~series
    if frac.any():
        xs = x[frac]
        tiny = 1e-300
        b = xs + 1 - a
        c = np.full_like(xs, 1 / tiny)
        d = 1 / b
        h = d.copy()
        for i in range(1, 1000):
            an = -i * (i - a)
            b = b + 2
            d = an * d + b
            d = np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            d = 1 / d
            delta = d * c
            h *= delta
            if np.all(np.abs(delta - 1) < 1e-15):
                break
        out[frac] = 1 - np.exp(-xs + a * np.log(xs) - math.lgamma(a)) * h
    return out


def chi2_cdf(x, df: float):
    return gamma_p(df / 2.0, np.asarray(x, dtype=float) / 2.0)


def chi2_ppf(q: float, df: float) -> float:
    """Quantile by bisection on the distribution function."""
    lo, hi = 0.0, max(10.0, df * 10.0)
    while chi2_cdf(hi, df)[0] < q:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if chi2_cdf(mid, df)[0] < q:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def beta_i(a, b, x):
    """Regularised incomplete beta by continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    a, b, x = a.copy(), b.copy(), np.clip(x, 0.0, 1.0).copy()
    swap = x > (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    safe = np.clip(xx, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(aa + bb) - _lgamma(aa) - _lgamma(bb) + aa * np.log(safe) + bb * np.log1p(-safe)) / aa
    tiny = 1e-300
    c = np.ones_like(xx)
    d = 1 - (aa + bb) * xx / (aa + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 500):
        m2 = 2 * m
        num = m * (bb - m) * xx / ((aa + m2 - 1) * (aa + m2))
        d = 1 + num * d
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = 1 + num / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        h *= d * c
        num = -(aa + m) * (aa + bb + m) * xx / ((aa + m2) * (aa + m2 + 1))
        d = 1 + num * d
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = 1 + num / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        delta = d * c
        h *= delta
        if np.all(np.abs(delta - 1) < 1e-15):
            break
    val = front * h
    val = np.where(xx <= 0, 0.0, val)
    return np.where(swap, 1 - val, val)


def t_two_sided(t, df):
    t = np.asarray(t, float)
    df = np.asarray(df, float)
    return beta_i(df / 2.0, 0.5, df / (df + t * t))


def normal_two_sided(z):
    return _erfc(np.abs(np.asarray(z, float)) / math.sqrt(2.0))


def normal_cdf(z):
    return 0.5 * _erfc(-np.asarray(z, float) / math.sqrt(2.0))


def kolmogorov_sf(x):
    """Asymptotic survival function of the Kolmogorov statistic times sqrt(n)."""
    x = float(x)
    if x < 0.2:
        return 1.0
    k = np.arange(1, 101)
    return float(np.clip(2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * k * k * x * x)), 0.0, 1.0))


def chi2_quantiles(q, df: float) -> np.ndarray:
    """Quantiles of many probabilities between 0 and 1: a cube-root normal start, then safeguarded Newton steps."""
    q = np.asarray(q, float)
    z = np.array([NormalDist().inv_cdf(v) for v in q])
    spread = 2.0 / (9.0 * df)
    x = df * np.maximum(1 - spread + z * math.sqrt(spread), 0.05) ** 3
    for _ in range(30):
        density = np.exp((df / 2 - 1) * np.log(x) - x / 2 - df / 2 * math.log(2) - math.lgamma(df / 2))
        step = (chi2_cdf(x, df) - q) / np.maximum(density, 1e-300)
        x = np.clip(x - step, x / 2, 2 * x + 1)
        if np.all(np.abs(step) <= 1e-12 * x):
            break
    return x


@F.pandas_udf(DoubleType())
def chi2_quantile_udf(q: pd.Series, df: pd.Series) -> pd.Series:
    """Quantiles of chi-square; null outside (0, 1)."""
    qv, dv = q.to_numpy(dtype=float), df.to_numpy(dtype=float)
    out = np.full(len(qv), np.nan)
    inside = (qv > 0) & (qv < 1)
    for d in np.unique(dv[inside]):
        m = inside & (dv == d)
        out[m] = chi2_quantiles(qv[m], d)
    return pd.Series(out).where(pd.Series(inside), None)


@F.pandas_udf(DoubleType())
def normal_p_udf(z: pd.Series) -> pd.Series:
    return pd.Series(normal_two_sided(z.to_numpy(dtype=float)))


@F.pandas_udf(DoubleType())
def correlation_p_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation coefficient from the t distribution."""
    rv = r.to_numpy(dtype=float)
    df = n.to_numpy(dtype=float) - 2
    ok = np.isfinite(rv) & (df > 0)
    out = np.full(len(rv), np.nan)
    if ok.any():
        rr = np.clip(rv[ok], -1.0, 1.0)
        with np.errstate(divide="ignore"):
            t = rr * np.sqrt(df[ok] / np.maximum(1 - rr * rr, 1e-300))
        out[ok] = t_two_sided(t, df[ok])
    return pd.Series(out).where(pd.Series(ok), None)


@F.pandas_udf(DoubleType())
def chi2_cdf_udf(x: pd.Series, df: pd.Series) -> pd.Series:
    """Distribution function of chi-square; batches share few distinct degrees of freedom."""
    xv, dv = x.to_numpy(dtype=float), df.to_numpy(dtype=float)
    out = np.full(len(xv), np.nan)
    for d in np.unique(dv[np.isfinite(dv)]):
        m = dv == d
        out[m] = chi2_cdf(xv[m], d)
    return pd.Series(out)
