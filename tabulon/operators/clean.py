"""Row and column removal: duplicates, padding, outliers, unwanted columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import (
    col, double, is_text, literal, missing, numeric_columns, present_sql, require, require_numeric, text_columns,
)
from ..functions.projection import Projection
from ..session import freeze
from .quantiles import column_quantiles


def delete_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the listed columns; names that do not exist are ignored."""
    return df.drop(*[c for c in columns if c in df.columns])


def deletion_report(df: DataFrame, columns: Sequence[str]) -> dict:
    rows, width = df.count(), len(df.columns)
    deleted = [c for c in dict.fromkeys(columns) if c in df.columns]
    return {
        "deleted_columns": deleted,
        "not_found_columns": [c for c in columns if c not in df.columns],
        "shape_before": (rows, width),
        "shape_after": (rows, width - len(deleted)),
    }


def split_xy(df: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Features and target; without a name the last column is the target."""
    target = df.columns[-1] if target is None else target
    require(df, target)
    return df.drop(target), df.select(col(target))


def select_numeric(df: DataFrame, first: int | None = None) -> DataFrame:
    return df.select(*[col(c) for c in numeric_columns(df)[:first]])


def select_categorical(df: DataFrame) -> DataFrame:
    return df.select(*[col(c) for c in text_columns(df)])


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep rows where every listed column is present."""
    require(df, *columns)
    for c in columns:
        df = df.where(~missing(df, c))
    return df


def dedupe(df: DataFrame) -> DataFrame:
    """One copy of every distinct row; copies combine before the shuffle."""
    return df.dropDuplicates()


def clean_text(df: DataFrame, column: str) -> DataFrame:
    """Dedupe, trim the column, drop rows left empty; nulls stay."""
    require(df, column)
    trimmed = dedupe(df).withColumn(column, F.trim(col(column)))
    return trimmed.where(col(column).isNull() | (col(column) != ""))


def fit_sigma(df: DataFrame, column: str, width: float = 3.0) -> Projection:
    """Keep values within mean +- width * sample standard deviation, bounds included."""
    require_numeric(df, column)
    value = double(df, column)
    mean, std = df.agg(F.avg(value), F.stddev_samp(value)).first()
    if mean is None or std is None:
        return Projection(where="false")
    x = present_sql(df, column)
    return Projection(where=f"{x} BETWEEN {literal(mean - width * std)} AND {literal(mean + width * std)}")


def clean_numeric(df: DataFrame, column: str, width: float = 3.0) -> DataFrame:
    unique = freeze(dedupe(df), "unique")  # fitted on, then filtered
    return fit_sigma(unique, column, width).apply(unique)


def clean_column(df: DataFrame, column: str) -> DataFrame:
    """Cleaning by type: text is trimmed, numbers lose their extremes, other types only duplicates."""
    require(df, column)
    if is_text(df, column):
        return clean_text(df, column)
    if column in numeric_columns(df):
        return clean_numeric(df, column)
    return dedupe(df)


def iqr_filter(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 1.5, cascade: bool = True
) -> DataFrame:
    """Keep rows within the quartile fences of every column.

    Cascading recomputes the quartiles of each column on the rows the previous ones kept;
    otherwise all fences come from one fit over the input.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    require_numeric(df, *columns)
    groups = [[c] for c in columns] if cascade else [columns]
    for group in groups:
        fences = iqr_fences(df, group, threshold)
        for c in group:
            lo, hi = fences[c]
            x = present_sql(df, c)
            where = "false" if lo is None else f"{x} BETWEEN {literal(lo)} AND {literal(hi)}"
            df = df.where(F.expr(where))
    return df


def iqr_fences(df: DataFrame, columns: Sequence[str], threshold: float = 1.5) -> dict[str, tuple]:
    found = column_quantiles(df, columns, (0.25, 0.75))
    fences = {}
    for c, (q1, q3) in found.items():
        fences[c] = (None, None) if q1 is None else (q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1))
    return fences
