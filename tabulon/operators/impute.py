"""Missing-value imputation: fit once, apply as one projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import (
    col, double, is_text, literal, numeric_columns, present, present_sql, quoted, require, require_numeric,
    text_columns,
)
from ..functions.projection import Projection
from .clean import drop_missing
from .ordered import fill
from .quantiles import column_quantiles

METHODS = ("mean", "median", "mode", "drop", "knn", "forward_fill", "backward_fill", "auto")


def _filled(df: DataFrame, column: str, value) -> str:
    if value is None:
        return quoted(column)
    return f"coalesce({present_sql(df, column)}, {literal(value)})"


def most_frequent(df: DataFrame, column: str):
    """The commonest present value, ties to the smallest; combines counts before the shuffle."""
    value = present(df, column).alias("v")
    row = (
        df.select(value).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
        .agg(F.min_by("v", F.struct((-F.col("n")).alias("n"), F.col("v")))).first()
    )
    return row[0]


def fit_means(df: DataFrame, columns: Sequence[str]) -> Projection:
    require_numeric(df, *columns)
    row = df.agg(*[F.avg(double(df, c)) for c in columns]).first()
    return Projection({c: _filled(df, c, v) for c, v in zip(columns, row)})


def fit_medians(df: DataFrame, columns: Sequence[str]) -> Projection:
    found = column_quantiles(df, list(columns), (0.5,))
    return Projection({c: _filled(df, c, found[c][0]) for c in columns})


def fit_constant(df: DataFrame, columns: Sequence[str], value: float = 0) -> Projection:
    require_numeric(df, *columns)
    return Projection({c: _filled(df, c, value) for c in columns})


def fit_modes(df: DataFrame, columns: Sequence[str]) -> Projection:
    require(df, *columns)
    texts = [c for c in columns if is_text(df, c)]
    values = text_modes(df, texts)
    values.update({c: most_frequent(df, c) for c in columns if c not in texts})
    return Projection({c: _filled(df, c, values[c]) for c in columns})


def text_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """The commonest value of several text columns in one scan."""
    if not columns:
        return {}
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), col(c).alias("v")) for c in columns])).alias("x")
    counts = df.select(cells).select("x.*").where("v IS NOT NULL").groupBy("c", "v").agg(F.count("*").alias("n"))
    best = counts.groupBy("c").agg(F.min_by("v", F.struct((-F.col("n")).alias("n"), F.col("v"))).alias("v"))
    found = {r["c"]: r["v"] for r in best.collect()}
    return {c: found.get(c) for c in columns}


def fit_imputation(df: DataFrame, column: str, method: str = "mean", categorical: bool = False) -> Projection:
    """Value-based methods; an unknown method, or mean on a category, picks mode for text and mean otherwise."""
    require(df, column)
    if method == "median":
        return fit_medians(df, [column])
    if method == "mode":
        return fit_modes(df, [column])
    if method == "mean" and not categorical:
        return fit_means(df, [column])
    if method == "knn":
        # neighbours of a lone column share nothing with a missing row, which leaves the column mean
        return fit_means(df, [column])
    if categorical or is_text(df, column):
        return fit_modes(df, [column])
    return fit_means(df, [column])


def impute(
    df: DataFrame,
    column: str,
    method: str = "mean",
    categorical: bool = False,
    order_by: Sequence[str] = (),
    keys: Sequence[str] = (),
) -> DataFrame:
    require(df, column)
    if method == "drop":
        return drop_missing(df, [column])
    if method in ("forward_fill", "backward_fill"):
        if not order_by:
            raise ValueError(f"{method} needs order_by")
        return fill(df, column, order_by, keys, backward=method == "backward_fill", value=present(df, column))
    return fit_imputation(df, column, method, categorical).apply(df)


def fit_table(df: DataFrame, strategy: str = "median", exclude: Sequence[str] = ()) -> Projection:
    """All numeric columns by median, mean or zero; all text columns by their commonest value."""
    numbers = [c for c in numeric_columns(df) if c not in exclude]
    texts = [c for c in text_columns(df) if c not in exclude]
    fit = {"median": fit_medians, "mean": fit_means}.get(strategy, fit_constant)
    columns = dict(fit(df, numbers).columns) if numbers else {}
    if texts:
        columns.update(fit_modes(df, texts).columns)
    return Projection(columns)


def impute_table(df: DataFrame, strategy: str = "median", exclude: Sequence[str] = ()) -> DataFrame:
    return fit_table(df, strategy, exclude).apply(df)
