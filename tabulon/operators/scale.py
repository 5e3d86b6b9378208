"""Scalers fitted by one aggregate and applied as one projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import double, literal, numeric_columns, present_sql, require_numeric
from ..functions.projection import Projection
from .quantiles import column_quantiles

ALIASES = {"standard": "zscore", "z-score": "zscore", "min-max": "minmax", "max-abs": "maxabs"}


def _centers(df: DataFrame, columns: Sequence[str], method: str) -> dict[str, tuple]:
    """Column -> (offset, divisor)."""
    if method == "robust":
        found = column_quantiles(df, columns, (0.25, 0.5, 0.75))
        return {c: (m, None if q1 is None else q3 - q1) for c, (q1, m, q3) in found.items()}
    values = {c: double(df, c) for c in columns}
    pairs = {
        "zscore": lambda v: (F.avg(v), F.stddev_pop(v)),
        "minmax": lambda v: (F.min(v), F.max(v) - F.min(v)),
        "maxabs": lambda v: (F.lit(0.0), F.max(F.abs(v))),
    }[method]
    row = df.agg(*[part for c in columns for part in pairs(values[c])]).first()
    return {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(columns)}


def fit_scaler(df: DataFrame, columns: Sequence[str] | None = None, method: str = "zscore") -> Projection:
    """Nulls stay null; a spread of zero divides by one."""
    method = ALIASES.get(method, method)
    if method not in ("zscore", "minmax", "robust", "maxabs"):
        raise ValueError(f"unknown scaling method: {method}")
    columns = numeric_columns(df) if columns is None else list(columns)
    require_numeric(df, *columns)
    if not columns:
        return Projection()
    out = {}
    for c, (offset, spread) in _centers(df, columns, method).items():
        x = f"CAST({present_sql(df, c)} AS DOUBLE)"
        if offset is None:
            out[c] = x
        else:
            out[c] = f"({x} - {literal(float(offset))}) / {literal(float(spread or 1.0))}"
    return Projection(out)


def scale(df: DataFrame, columns: Sequence[str] | None = None, method: str = "zscore") -> DataFrame:
    return fit_scaler(df, columns, method).apply(df)
