"""Column lookup, type classes and SQL literals."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"column(s) not found: {', '.join(missing)}")


def require_numeric(df: DataFrame, *names: str) -> None:
    require(df, *names)
    wrong = [n for n in names if not isinstance(df.schema[n].dataType, T.NumericType)]
    if wrong:
        raise ValueError(f"column(s) not numeric: {', '.join(wrong)}")


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))


def present_sql(df: DataFrame, name: str) -> str:
    """SQL for a column with NaN read as NULL, since the two mean the same thing here."""
    return f"nullif({quoted(name)}, double('NaN'))" if is_float(df, name) else quoted(name)


def present(df: DataFrame, name: str) -> Column:
    return F.expr(present_sql(df, name))


def double(df: DataFrame, name: str) -> Column:
    return F.expr(f"CAST({present_sql(df, name)} AS DOUBLE)")


def missing(df: DataFrame, name: str) -> Column:
    return present(df, name).isNull()


def literal(value) -> str:
    """A Spark SQL literal for a fitted value."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            return f"double('{value}')"
        return f"{value!r}D"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def unused(names: Iterable[str], stem: str) -> str:
    """A helper column name that does not clash with ``names``."""
    taken = set(names)
    name, i = stem, 0
    while name in taken:
        i += 1
        name = f"{stem}{i}"
    return name
