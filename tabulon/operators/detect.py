"""Deciding whether a target column means classification or regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import is_text, present, require

# distinct-value rules: at most / fewer than this many values means classification
SCRIPT_LIMIT = 20
SELECTION_LIMIT = 10
SHARE_LIMIT = 0.05
SURELY_MANY = 1000


def distinct_values(df: DataFrame, column: str, enough: int = SURELY_MANY) -> int:
    """Exact distinct count, except that a sketch settles clearly large ones without a shuffle of all values."""
    value = present(df, column)
    rough = df.agg(F.approx_count_distinct(value, 0.05)).first()[0]
    if rough > 2 * enough:
        return rough
    return df.agg(F.countDistinct(value)).first()[0]


def classify_target(df: DataFrame, target: str, rule: str = "script") -> bool:
    """True for classification.

    ``script``: text or <= 20 values; ``selection``: text or < 10 values; ``share``: < 10 values or
    fewer than 5 % of the rows are distinct.
    """
    require(df, target)
    if rule not in ("script", "selection", "share"):
        raise ValueError(f"unknown rule: {rule}")
    if rule != "share" and is_text(df, target):
        return True
    if rule == "share":
        value = present(df, target)
        n, distinct = df.agg(F.count(F.lit(1)), F.countDistinct(value)).first()
        return distinct < SELECTION_LIMIT or distinct < SHARE_LIMIT * n
    distinct = distinct_values(df, target)
    return distinct <= SCRIPT_LIMIT if rule == "script" else distinct < SELECTION_LIMIT


def detect_task(df: DataFrame, target: str, rule: str = "script") -> str:
    return "classification" if classify_target(df, target, rule) else "regression"
