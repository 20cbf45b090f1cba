"""Two-sided Student t probability, for whole columns at once."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, row by row side by side until all have settled."""
    floor = lambda v: np.where(np.abs(v) > _TINY, v, _TINY)
    c = np.ones_like(x)
    d = 1.0 / floor(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, 400):
        for coef in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / floor(1.0 + coef * d)
            c = floor(1.0 + coef / c)
            h = h * c * d
        if np.all(np.abs(c * d - 1.0) < 1e-15):
            break
    return h


def regularized_beta(a, b, x) -> np.ndarray:
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    near = inner < (a + 1.0) / (a + b + 2.0)
    f = _beta_fraction(np.where(near, a, b), np.where(near, b, a), np.where(near, inner, 1.0 - inner))
    value = np.where(near, front * f / a, 1.0 - front * f / b)
    return np.where(x <= 0.0, 0.0, np.where(x >= 1.0, 1.0, value))


def t_two_sided(t, df) -> np.ndarray:
    """p of |T| >= |t|; NaN where t or df is missing or df is not positive, 0 for an infinite t."""
    t, df = (np.atleast_1d(np.asarray(v, float)) for v in (t, df))
    ok = ~np.isnan(t) & ~np.isnan(df) & (df > 0)
    n, v = np.where(ok, df, 1.0), np.where(ok & np.isfinite(t), t, 0.0)
    p = regularized_beta(n / 2.0, 0.5, n / (n + v * v)) if len(t) else t
    return np.where(ok, np.where(np.isinf(t), 0.0, p), np.nan)


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """p of |T| >= |t|; one row per unit or pair of groups, never per event."""
    p = t_two_sided(t.to_numpy(float), df.to_numpy(float))
    return pd.Series(p, dtype="float64").where(~np.isnan(p), None)
