"""Distribution functions that SQL lacks, vectorised over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    safe = lambda v: v if abs(v) > 1e-300 else 1e-300
    # The fraction 1 / (1 + t1 / (1 + t2 / ...)), evaluated forwards by ratios of successive convergents.
    upper, lower = 1.0, 1 / safe(1 - (a + b) * x / (a + 1))
    value = lower
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            upper, lower = safe(1 + term / upper), 1 / safe(1 + term * lower)
            value *= upper * lower
        if abs(upper * lower - 1) < 1e-15:
            break
    return front * value


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p-value of a standard normal statistic; null without one."""
    return pd.Series([None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2)) for x in z], dtype="float64")


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation of n pairs; null under three pairs or without a correlation."""

    def one(r: float, n: float) -> float | None:
        if r is None or np.isnan(r) or np.isnan(n) or n < 3:
            return None
        return 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)

    return pd.Series([one(a, b) for a, b in zip(r, n, strict=True)], dtype="float64")


def hashed_pick(seed: int, n: Column, *place: Column) -> Column:
    """A number from 0 to n - 1 that depends on the seed and the place alone: the first 60 bits of an MD5, modulo n."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *(c.cast("string") for c in place)).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), n)


def finite(value: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def is_close(a: Column, b: Column, tolerance: float = 1e-8) -> Column:
    """Equal up to a relative or absolute tolerance."""
    return F.abs(a - b) <= F.greatest(tolerance * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))
