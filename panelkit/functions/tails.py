"""Tail probabilities for already aggregated rows.

The functions are vectorised over a batch and run as pandas UDFs on one row
per test, after all reductions are done in Spark.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(200)
EXACT_SIGNED_RANK_N = 50


def lgamma(x: np.ndarray) -> np.ndarray:
    return np.asarray(np.frompyfunc(math.lgamma, 1, 1)(x), float)


def normal_sf(z: np.ndarray) -> np.ndarray:
    erfc = np.frompyfunc(math.erfc, 1, 1)
    return 0.5 * np.asarray(erfc(np.asarray(z, float) / math.sqrt(2.0)), float)


def t_sf(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(T > t).  With u = atan(t / sqrt(df)) the density is cos(u)**(df - 1);
    the tail is integrated by Gauss-Legendre over the part that matters."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    lo = np.arctan(np.abs(t) / np.sqrt(df))
    # beyond this width the integrand is below 1e-18 of its value at ``lo``
    slope = (df - 1.0) * np.tan(np.minimum(lo, math.pi / 2 - 1e-12))
    width = np.minimum(math.pi / 2 - lo, np.minimum(42.0 / np.maximum(slope, 1e-9), 9.5 / np.sqrt(np.maximum(df - 1.0, 1e-9))))
    u = lo[..., None] + width[..., None] * (_NODES + 1.0) / 2.0
    log_c = lgamma((df + 1.0) / 2.0) - lgamma(df / 2.0) - 0.5 * math.log(math.pi)
    with np.errstate(divide="ignore"):
        log_f = (df[..., None] - 1.0) * np.log(np.maximum(np.cos(u), 1e-300)) + log_c[..., None]
    upper = (np.exp(log_f) * _WEIGHTS).sum(axis=-1) * width / 2.0
    out = np.where(t >= 0, upper, 1.0 - upper)
    return np.where(np.isfinite(t) & (df > 0), out, np.where(t == np.inf, 0.0, np.where(t == -np.inf, 1.0, np.nan)))


def t_ppf(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Quantile by bisection on ``t_sf``; p in (0, 1)."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    lo, hi = np.full(p.shape, -1.0), np.full(p.shape, 1.0)
    for _ in range(60):
        grow = t_sf(hi, df) > 1.0 - p
        shrink = t_sf(lo, df) < 1.0 - p
        if not (grow.any() or shrink.any()):
            break
        hi, lo = np.where(grow, hi * 2, hi), np.where(shrink, lo * 2, lo)
    for _ in range(80):
        mid = (lo + hi) / 2
        below = t_sf(mid, df) > 1.0 - p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def chi2_sf(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(X > x).  With x = s**2 the density is smooth; integrated from x on."""
    x, df = np.broadcast_arrays(np.asarray(x, float), np.asarray(df, float))
    lo = np.sqrt(np.maximum(x, 0.0))
    peak = np.sqrt(np.maximum(df - 1.0, 0.0))
    hi = np.maximum(lo, peak) + 12.0
    s = lo[..., None] + (hi - lo)[..., None] * (_NODES + 1.0) / 2.0
    log_c = math.log(2.0) * (1.0 - df / 2.0) - lgamma(df / 2.0)
    log_f = (df[..., None] - 1.0) * np.log(np.maximum(s, 1e-300)) - s * s / 2.0 + log_c[..., None]
    return np.clip((np.exp(log_f) * _WEIGHTS).sum(axis=-1) * (hi - lo) / 2.0, 0.0, 1.0)


def sign_test_p(wins: float, n: float) -> float:
    """Two-sided exact binomial test at 1/2."""
    if n <= 0:
        return math.nan
    w, n = int(min(wins, n - wins)), int(n)
    i = np.arange(w + 1, dtype=float)
    logs = math.lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * math.log(2.0)
    return min(1.0, 2.0 * float(np.exp(logs).sum()))


def signed_rank_p(stat: float, n: float, tie_sum: float, had_zeros: bool) -> float:
    """Two-sided signed-rank p from T = min(W+, W-).

    Exact (subset sums of 1..n) for n <= 50 without ties or zeros, otherwise
    the normal approximation with tie correction; ``tie_sum`` is the sum of
    t**3 - t over tie groups.
    """
    if not n or n != n:
        return math.nan
    n = int(n)
    if n <= EXACT_SIGNED_RANK_N and tie_sum == 0 and not had_zeros:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1.0
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return min(1.0, 2.0 * float(ways[: int(math.floor(stat)) + 1].sum()) / 2.0**n)
    var = n * (n + 1) * (2 * n + 1) / 24.0 - tie_sum / 48.0
    if var <= 0:
        return math.nan
    z = (stat - n * (n + 1) / 4.0) / math.sqrt(var)
    return float(2.0 * normal_sf(np.array(abs(z))))


def studentised_range_q(k: int, alpha: float = 0.05) -> float:
    """Upper quantile of the studentised range with infinite degrees of freedom."""
    z = 8.5 * _NODES
    phi = np.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)
    cdf = 1.0 - normal_sf(z)

    def upper(q: float) -> float:
        inner = np.clip(cdf - (1.0 - normal_sf(z - q)), 0.0, 1.0)
        return 1.0 - 8.5 * float((k * phi * inner ** (k - 1) * _WEIGHTS).sum())

    lo, hi = 0.0, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if upper(mid) > alpha else (lo, mid)
    return (lo + hi) / 2.0


@F.pandas_udf(T.DoubleType())
def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(2.0 * t_sf(t.abs().to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def _t_upper(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_sf(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def _t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_ppf(p.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def _chi2_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_sf(x.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def _sign_test(wins: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([sign_test_p(w, m) for w, m in zip(wins, n)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _signed_rank(stat: pd.Series, n: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
    rows = zip(stat, n, ties, zeros)
    return pd.Series([signed_rank_p(s, m, t, z > 0) for s, m, t, z in rows], dtype=float)


def _guarded(value: Column, *inputs: Column) -> Column:
    known = F.lit(True)
    for c in inputs:
        known = known & c.isNotNull()
    return F.when(known & ~F.isnan(value), value)


def p_t_two_sided(t: Column, df: Column) -> Column:
    t, df = t.cast("double"), df.cast("double")
    return _guarded(_t_two_sided(t, df), t, df)


def p_t_upper(t: Column, df: Column) -> Column:
    t, df = t.cast("double"), df.cast("double")
    return _guarded(_t_upper(t, df), t, df)


def t_quantile(p: float, df: Column) -> Column:
    df = df.cast("double")
    return _guarded(_t_quantile(F.lit(float(p)), df), df)


def p_chi2(x: Column, df: Column) -> Column:
    x, df = x.cast("double"), df.cast("double")
    return _guarded(_chi2_upper(x, df), x, df)


def p_sign(wins: Column, n: Column) -> Column:
    wins, n = wins.cast("double"), n.cast("double")
    return _guarded(_sign_test(wins, n), wins, n)


def p_signed_rank(stat: Column, n: Column, tie_sum: Column, zeros: Column) -> Column:
    args = [c.cast("double") for c in (stat, n, tie_sum, zeros)]
    return _guarded(_signed_rank(*args), *args)
