"""Derived numeric features."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement, islice

from pyspark.sql import DataFrame

from ..functions.columns import numeric_columns, present_sql
from ..functions.projection import Projection

#: Limits of the plain calls; pass ``inputs=None`` or a larger ``limit`` to lift them.
MAX_INPUTS = 10
MAX_POLYNOMIALS = 1000
MAX_INTERACTIONS = 50


def fit_polynomial(df: DataFrame, degree: int = 2, limit: int = MAX_POLYNOMIALS, target: str | None = None, inputs: int | None = MAX_INPUTS) -> Projection:
    """All monomials of degree 1..d of the first numeric columns, which they replace at the end of the row."""
    used = [c for c in numeric_columns(df) if c != target][:inputs]
    out: dict[str, str] = {}
    for d in range(1, degree + 1):
        for combo in combinations_with_replacement(used, d):
            powers = {c: combo.count(c) for c in dict.fromkeys(combo)}
            name = " ".join(c if p == 1 else f"{c}^{p}" for c, p in powers.items())
            out[name] = " * ".join(f"CAST({present_sql(df, c)} AS DOUBLE)" for c in combo)
            if len(out) == limit:
                return _moved(out, used)
    return _moved(out, used)


def _moved(out: dict[str, str], inputs: list[str]) -> Projection:
    # the degree-1 terms carry the input names: drop and re-append so that the new block comes last
    return _Tail(out, dropped=tuple(inputs))


class _Tail(Projection):
    def _select(self, names: list[str]) -> list[str]:
        return super()._select([n for n in names if n not in self.dropped])


def polynomial(df: DataFrame, degree: int = 2, limit: int = MAX_POLYNOMIALS, inputs: int | None = MAX_INPUTS) -> DataFrame:
    return fit_polynomial(df, degree, limit, inputs=inputs).apply(df)


def fit_interaction(df: DataFrame, limit: int = MAX_INTERACTIONS, target: str | None = None, inputs: int | None = MAX_INPUTS) -> Projection:
    """Products of pairs of the first numeric columns, appended as ``a_x_b``."""
    used = [c for c in numeric_columns(df) if c != target][:inputs]
    pairs = list(islice(combinations(used, 2), limit))
    return Projection(
        {f"{a}_x_{b}": f"CAST({present_sql(df, a)} AS DOUBLE) * CAST({present_sql(df, b)} AS DOUBLE)" for a, b in pairs}
    )


def interaction(df: DataFrame, limit: int = MAX_INTERACTIONS, inputs: int | None = MAX_INPUTS) -> DataFrame:
    return fit_interaction(df, limit, inputs=inputs).apply(df)
