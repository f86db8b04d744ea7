"""Two-sided p-values of Student's t, vectorized; for small result tables."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_inc(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by Lentz's continued fraction, on the side where it converges fast."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(all="ignore"):
        log_front = np.array([lgamma(i + j) - lgamma(i) - lgamma(j) for i, j in zip(p.ravel(), q.ravel(), strict=True)]).reshape(p.shape) + p * np.log(y) + q * np.log1p(-y)
        c, d = np.ones_like(y), 1 / np.where(np.abs(1 - (p + q) * y / (p + 1)) < 1e-300, 1e-300, 1 - (p + q) * y / (p + 1))
        h = d.copy()
        for m in range(1, 300):
            for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 / (1 + top * d)
                c = 1 + top / c
                h = h * c * d
        out = np.exp(log_front) * h / p
    out = np.where(y <= 0, 0.0, out)
    return np.where(flip, 1 - out, out)


def t_p_value(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        ok = (t.notna() & df.notna() & (df > 0)).to_numpy()
        out = np.full(len(t), np.nan)
        n = df.to_numpy(float)[ok]
        out[ok] = beta_inc(n / 2, 0.5, n / (n + t.to_numpy(float)[ok] ** 2))
        return pd.Series(out).where(ok, None)

    return run(t, df)
