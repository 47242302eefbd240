"""Tail probabilities, vectorized with numpy over Arrow batches.

Spark SQL has no error function, incomplete beta or incomplete gamma.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EULER_GAMMA = 0.5772156649015329
_TINY = 1e-300

# Coefficients of the Lanczos approximation to the gamma function (g = 7, n = 9).
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive arguments."""
    x = np.asarray(x, float) - 1.0
    series = LANCZOS[0] + sum(c / (x + k) for k, c in enumerate(LANCZOS[1:], 1))
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * np.log(t) - t + np.log(series)


def _nonzero(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) > _TINY, x, _TINY)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta (modified Lentz), all arguments at once."""
    c = np.ones_like(x)
    d = 1.0 / _nonzero(1.0 - (a + b) * x / (a + 1.0))
    out = d.copy()
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 / _nonzero(1.0 + step * d)
            c = _nonzero(1.0 + step / c)
            out *= d * c
        if (np.abs(d * c - 1.0) < 1e-15).all():
            break
    return out


def incomplete_beta(a, b, x) -> np.ndarray:
    """The regularized incomplete beta function; 0 and 1 beyond the ends."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    inner = np.clip(x, 1e-300, 1.0 - 1e-16)
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    low = inner < (a + 1.0) / (a + b + 2.0)
    p, q, z = np.where(low, a, b), np.where(low, b, a), np.where(low, inner, 1.0 - inner)
    part = front * _beta_fraction(p, q, z) / p
    return np.where(x <= 0.0, 0.0, np.where(x >= 1.0, 1.0, np.where(low, part, 1.0 - part)))


def student_two_sided(t, df) -> np.ndarray:
    """Two-sided Student p-values; 0 for an infinite t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    with np.errstate(invalid="ignore"):
        share = np.where(np.isinf(t), 0.0, df / (df + t * t))
    return incomplete_beta(df / 2.0, 0.5, share)


def chi2_survival(x, df: int) -> np.ndarray:
    """Survival function of the chi-square distribution, any whole degrees of freedom."""
    half = np.maximum(np.asarray(x, float), 0.0) / 2.0
    # From 2 (or 1) degrees up, two at a time: Q(a + 1, x) = Q(a, x) + x^a e^-x / Gamma(a + 1).
    if df % 2:
        out, a = np.vectorize(math.erfc, otypes=[float])(np.sqrt(half)), 0.5
    else:
        out, a = np.exp(-half), 1.0
    while a < df / 2.0:
        out = out + np.exp(a * np.log(np.maximum(half, _TINY)) - half - math.lgamma(a + 1.0))
        a += 1.0
    return np.where(half == 0.0, 1.0, out)


def expected_max_sharpe(n_trials: int, sr_variance: float) -> float:
    """Expected best Sharpe ratio among ``n_trials`` of pure noise."""
    if n_trials < 2:
        return 0.0
    normal = NormalDist()
    low = normal.inv_cdf(1.0 - 1.0 / n_trials)
    high = normal.inv_cdf(1.0 - 1.0 / (n_trials * math.e))
    return math.sqrt(sr_variance) * ((1.0 - EULER_GAMMA) * low + EULER_GAMMA * high)


def _null_safe(fn, *series: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(v) for v in row) else fn(*row)
                      for row in zip(*series)], dtype="float64")


def student_p(t: Column, df: Column) -> Column:
    """Two-sided Student p-value; null without a positive number of degrees of freedom."""
    @F.pandas_udf("double")
    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, t.index)
        ok = t.notna() & (df > 0)
        out[ok] = student_two_sided(t[ok].to_numpy(), df[ok].to_numpy())
        return out.where(ok, None)
    return run(t.cast("double"), df.cast("double"))


def chi2_p(x: Column, df: Column) -> Column:
    """Upper tail of the chi-square distribution; null without a whole, positive number of degrees of freedom."""
    @F.pandas_udf("double")
    def run(x: pd.Series, df: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, x.index)
        for k in df[x.notna() & (df > 0)].unique():
            rows = x.notna() & (df == k)
            out[rows] = chi2_survival(x[rows].to_numpy(), int(k))
        return out.where(out.notna(), None)
    return run(x.cast("double"), df.cast("long"))


def normal_cdf(z: Column) -> Column:
    @F.pandas_udf("double")
    def run(z: pd.Series) -> pd.Series:
        return _null_safe(lambda v: 0.5 * math.erfc(-v / math.sqrt(2.0)), z)
    return run(z.cast("double"))


def noise_benchmark(n_trials: int, sr_variance: Column) -> Column:
    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return _null_safe(lambda x: expected_max_sharpe(n_trials, x), v)
    return run(sr_variance.cast("double"))
