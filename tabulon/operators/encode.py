"""Categorical encoders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import distinct_cells
from ..functions.columns import col, double, literal, quoted, require, require_numeric, text_columns
from ..functions.projection import Projection
from ..session import freeze
from .lookup import lookup_join
from .ordered import row_numbers
from .split import fold_column

MAX_CATEGORIES = 1000


def categories(df: DataFrame, column: str, limit: int = MAX_CATEGORIES) -> list:
    """Sorted distinct present values; an error beyond ``limit``, never a truncated list."""
    require(df, column)
    rows = df.select(col(column).alias("v")).where("v IS NOT NULL").distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"column {column} has more than {limit} categories")
    return sorted(r[0] for r in rows)


def fit_onehot(df: DataFrame, column: str, drop_first: bool = True, limit: int = MAX_CATEGORIES) -> Projection:
    """0/1 columns ``column_value`` in category order, the source removed; null and unseen are all zero."""
    values = categories(df, column, limit)[1 if drop_first else 0:]
    return Projection(
        {f"{column}_{v}": f"int(coalesce({quoted(column)} = {literal(v)}, false))" for v in values}, dropped=(column,)
    )


def onehot(df: DataFrame, column: str, drop_first: bool = True) -> DataFrame:
    return fit_onehot(df, column, drop_first).apply(df)


def fit_codes(df: DataFrame, column: str, null_as: str | None = None) -> DataFrame:
    """(value, code) with codes 0.. in sorted text order; ``null_as`` gives nulls a category."""
    require(df, column)
    value = col(column)
    if null_as is not None:
        value = F.coalesce(value.cast("string"), F.lit(null_as))
    distinct = df.select(value.alias(column)).where(col(column).isNotNull()).distinct()
    numbered = row_numbers(distinct, [col(column)], "__code")
    return numbered.select(col(column), (F.col("__code") - 1).alias("__code"))


def _coded(df: DataFrame, column: str, key: Column, codes: DataFrame, absent: Column | None) -> DataFrame:
    names = df.columns
    keyed = df.withColumn("__key", key)
    joined = lookup_join(keyed, codes.withColumnRenamed(column, "__key"), ["__key"])
    code = F.col("__code") if absent is None else F.coalesce(F.col("__code"), absent)
    return joined.select(*[code.alias(column) if n == column else col(n) for n in names])


def label_encode(df: DataFrame, column: str, codes: DataFrame | None = None) -> DataFrame:
    """Codes by sorted text; null is the category "nan"."""
    codes = fit_codes(df, column, null_as="nan") if codes is None else codes
    return _coded(df, column, F.coalesce(col(column).cast("string"), F.lit("nan")), codes, None)


def ordinal_encode(df: DataFrame, column: str, codes: DataFrame | None = None) -> DataFrame:
    """Sorted category codes; null (and unseen) is -1."""
    codes = fit_codes(df, column) if codes is None else codes
    return _coded(df, column, col(column), codes, F.lit(-1).cast("long"))


def label_encode_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Codes of several columns by sorted text, from one pass over their distinct values; null is the category "nan"."""
    columns = text_columns(df) if columns is None else list(columns)
    require(df, *columns)
    if not columns:
        return df
    texts = df.select(*[F.coalesce(col(c).cast("string"), F.lit("nan")).alias(f"v{i}") for i, c in enumerate(columns)])
    values = freeze(distinct_cells(texts, texts.columns), "values")
    order = [F.col("c"), F.col("value")]
    places = row_numbers(values, order, "place")
    first = places.groupBy("c").agg(F.min("place").alias("first"))  # one row for each column
    codes = freeze(places.join(F.broadcast(first), "c").select("c", "value", (F.col("place") - F.col("first")).cast("long").alias("__code")), "codes")
    for i, c in enumerate(columns):
        own = codes.where(F.col("c") == i).select(F.col("value").alias(c), "__code")
        df = _coded(df, c, F.coalesce(col(c).cast("string"), F.lit("nan")), own, None)
    return df


def encode(df: DataFrame, column: str, method: str = "one-hot") -> DataFrame:
    methods = {"one-hot": onehot, "label": label_encode, "ordinal": ordinal_encode}
    require(df, column)
    if method not in methods:
        raise ValueError(f"unknown encoding method: {method}")
    return methods[method](df, column)


def target_statistics(df: DataFrame, column: str, target: str) -> DataFrame:
    """Per category: count, sum and sum of squares of the target; nulls are a category."""
    require_numeric(df, target)
    y = double(df, target)
    return df.groupBy(col(column).alias(column)).agg(
        F.count(y).alias("__n"), F.sum(y).alias("__s"), F.sum(y * y).alias("__q")
    )


def shrunk_mean(n: Column, s: Column, q: Column, mean: Column, variance: Column) -> Column:
    """Category mean pulled to the overall mean by the ratio of its variance to the overall one."""
    within = F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))
    weight = F.when(variance * n + within == 0, F.lit(0.0)).otherwise(variance * n / (variance * n + within))
    return F.when(n > 0, weight * s / n + (1 - weight) * mean).otherwise(mean)


def fit_target(df: DataFrame, column: str, target: str) -> tuple[DataFrame, float]:
    """(category, encoding) from all rows, and the overall mean for unseen categories."""
    y = double(df, target)
    mean, variance = df.agg(F.avg(y), F.var_pop(y)).first()
    stats = target_statistics(df, column, target)
    value = shrunk_mean(F.col("__n"), F.col("__s"), F.col("__q"), F.lit(mean), F.lit(variance))
    return stats.select(col(column), value.alias("__code")), mean


def target_encode(df: DataFrame, column: str, target: str, fitted: tuple[DataFrame, float] | None = None) -> DataFrame:
    codes, mean = fit_target(df, column, target) if fitted is None else fitted
    return _coded(df, column, _text_key(df, column), _text_codes(codes, column), F.lit(mean))


def _text_key(df: DataFrame, column: str) -> Column:
    return F.concat_ws("", F.when(col(column).isNull(), "n").otherwise("v"), col(column).cast("string"))


def _text_codes(codes: DataFrame, column: str) -> DataFrame:
    return codes.withColumn(column, _text_key(codes, column))


def target_cells(df: DataFrame, columns: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., c, key, n, s, q): target moments of every category of several columns, from one aggregate."""
    require_numeric(df, target)
    each = F.array(*[F.struct(F.lit(i).alias("c"), _text_key(df, c).alias("key")) for i, c in enumerate(columns)])
    rows = df.select(*[col(b) for b in by], double(df, target).alias("y"), F.explode(each).alias("x")).select(*[col(b) for b in by], "x.c", "x.key", "y")
    return rows.groupBy(*[col(b) for b in by], "c", "key").agg(F.count("y").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))


def target_encode_crossfit(
    df: DataFrame, columns: str | Sequence[str], target: str, keys: Sequence[str], folds: int = 5, seed: int = 42
) -> DataFrame:
    """Each row is encoded from the other folds only: totals minus the row's own fold.

    One aggregation to (fold, column, category) for all columns and one lookup for each; the folds themselves are
    expressions.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    names = df.columns
    folded = fold_column(df, keys, folds, seed=seed, name="__fold")
    cells = freeze(target_cells(folded, columns, target, ["__fold"]), "cells")  # a row for each fold and category
    totals = cells.groupBy("c", "key").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    fold_rows = cells.where("c = 0").groupBy("__fold").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    fits = {r["__fold"]: (r["n"], r["s"] or 0.0, r["q"] or 0.0) for r in fold_rows.collect()}
    n_all, s_all, q_all = (sum(v[i] for v in fits.values()) for i in range(3))
    mean, variance = F.lit(None).cast("double"), F.lit(None).cast("double")
    for fold, (n, s, q) in fits.items():
        rest = n_all - n
        if rest > 0:
            m = (s_all - s) / rest
            v = max((q_all - q) / rest - m * m, 0.0)
            mean = F.when(F.col("__fold") == fold, F.lit(m)).otherwise(mean)
            variance = F.when(F.col("__fold") == fold, F.lit(v)).otherwise(variance)
    out = cells.join(totals, ["c", "key"]).select(
        "__fold", "c", F.col("key").alias("__key"),
        (F.col("tn") - F.col("n")).alias("n"),
        (F.coalesce("ts", F.lit(0.0)) - F.coalesce("s", F.lit(0.0))).alias("s"),
        (F.coalesce("tq", F.lit(0.0)) - F.coalesce("q", F.lit(0.0))).alias("q"),
    ).select("__fold", "c", "__key", shrunk_mean(F.col("n"), F.col("s"), F.col("q"), mean, variance).alias("__code"))
    out = freeze(out, "codes")
    for i, column in enumerate(columns):
        keyed = folded.withColumn("__key", _text_key(folded, column))
        joined = lookup_join(keyed, out.where(F.col("c") == i).drop("c"), ["__fold", "__key"], derived=False)
        folded = joined.withColumn(column, F.col("__code")).drop("__key", "__code")
    return folded.select(*[col(n) for n in names])
