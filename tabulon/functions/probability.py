"""Tail probabilities for the tests, as column expressions or small batch helpers."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

KOLMOGOROV_TERMS = 100


def kolmogorov_pvalue(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value, clipped to [0, 1]."""
    n, m = n.cast("double"), m.cast("double")
    lam = F.sqrt(n * m / (n + m)) * d
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(KOLMOGOROV_TERMS)),
        lambda k: F.pow(F.lit(-1.0), k - 1) * F.exp(F.lit(-2.0) * k * k * lam * lam),
    )
    total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    # the alternating series does not converge near zero, where p is 1 anyway
    return F.when(lam < 0.04, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * total)))


def chi2_tail(x: float, dof: int) -> float:
    """P(chi-square with ``dof`` degrees of freedom > x), finite sums for integer ``dof``."""
    if dof <= 0 or x <= 0:
        return 1.0
    half = x / 2.0
    if dof % 2 == 0:
        log_term, total, i = -half, math.exp(-half), 0
        while i < dof // 2 - 1:
            i += 1
            log_term += math.log(half / i)
            total += math.exp(log_term)
        return min(1.0, total)
    total = math.erfc(math.sqrt(half))
    log_term = -half + 0.5 * math.log(half) - math.lgamma(1.5)
    for i in range((dof - 1) // 2):
        total += math.exp(log_term)
        log_term += math.log(half / (i + 1.5))
    return min(1.0, total)


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """Batch form of :func:`chi2_tail`; used on one row per pair of columns."""
    return pd.Series(
        [None if pd.isna(s) or pd.isna(d) else chi2_tail(float(s), int(d)) for s, d in zip(stat, dof)],
        dtype="float64",
    )
