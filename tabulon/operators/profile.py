"""Table profiles and summary statistics, one pass for all columns wherever possible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.cells import cell_text, distinct_cells
from ..functions.columns import (
    col, double, missing, numeric_columns, present, require, require_numeric, text_columns,
)
from ..session import freeze
from .quantiles import column_quantiles

TOP_TEXT_COLUMNS = 5
TOP_VALUES = 5


def unpivot_row(df: DataFrame, cells: Sequence[tuple[str, str]], name: str = "column", value: str = "value") -> DataFrame:
    """Turn the columns of a one-row table into (name, value) rows: ``cells`` are (label, source column)."""
    pairs = [F.struct(F.lit(label).alias(name), col(source).alias(value)) for label, source in cells]
    return df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) for every column from one aggregate."""
    row = df.agg(*[F.count_if(missing(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return unpivot_row(row, [(c, f"c{i}") for i, c in enumerate(df.columns)], value="nulls")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row; copies combine before the shuffle."""
    copies = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__copies"))
    return copies.agg(F.coalesce(F.sum(F.col("__copies") - 1), F.lit(0)).cast("long").alias("duplicates"))


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles and max per numeric column."""
    columns = numeric_columns(df) if columns is None else list(columns)
    require_numeric(df, *columns)
    if not columns:
        raise ValueError("no numeric column")
    quartiles = column_quantiles(df, columns, (0.25, 0.5, 0.75))
    aggs = []
    for i, c in enumerate(columns):
        v = double(df, c)
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(v).alias("count"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("std"),
                F.min(v).alias("min"),
                *[F.lit(q).cast("double").alias(n) for q, n in zip(quartiles[c], ("p25", "p50", "p75"))],
                F.max(v).alias("max"),
            ).alias(f"c{i}")
        )
    return df.agg(*aggs).select(F.explode(F.array(*[f"c{i}" for i in range(len(columns))])).alias("x")).select("x.*")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, count), most frequent first, nulls left out."""
    require(df, column)
    counts = df.select(present(df, column).alias("value")).where("value IS NOT NULL").groupBy("value").agg(
        F.count(F.lit(1)).alias("count")
    )
    return counts.orderBy(F.desc("count"), F.asc("value"))


def top_values(df: DataFrame, column: str, k: int = TOP_VALUES) -> DataFrame:
    return value_counts(df, column).limit(k)


def _text_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("x")).select("x.*").where("value IS NOT NULL").groupBy(
        "column", "value"
    ).agg(F.count(F.lit(1)).alias("count"))


def categorical_topk(df: DataFrame, columns: Sequence[str] | None = None, k: int = TOP_VALUES) -> DataFrame:
    """Distinct count and the k commonest values of the first text columns, from one scan.

    The running best k is kept by an aggregate-side top-k, so a column of many distinct values never
    sorts in one task.
    """
    columns = text_columns(df)[:TOP_TEXT_COLUMNS] if columns is None else list(columns)
    require(df, *columns)
    if not columns:
        raise ValueError("no text column")
    counts = freeze(_text_cells(df, columns), "cells")  # read twice
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_values"))
    buckets = counts.withColumn("__b", F.pmod(F.xxhash64("value"), F.lit(64)))
    order = [F.desc("count"), F.asc("value")]
    part = buckets.withColumn("__r", F.row_number().over(Window.partitionBy("column", "__b").orderBy(*order)))
    best = part.where(F.col("__r") <= k).withColumn(
        "rank", F.row_number().over(Window.partitionBy("column").orderBy(*order))
    )
    best = best.where(F.col("rank") <= k).select("column", "value", "count", F.col("rank").cast("long"))
    return best.join(F.broadcast(distinct), "column")


def nunique(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, distinct_values), nulls not counted; each batch sends its distinct values only."""
    columns = list(df.columns) if columns is None else list(columns)
    require(df, *columns)
    found = distinct_cells(df, columns).groupBy("c").agg(F.count(F.lit(1)).alias("distinct_values"))
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "c int, column string")
    return names.join(found, "c", "left").select("column", F.coalesce("distinct_values", F.lit(0).cast("long")).alias("distinct_values"))


def distinct_sketches(df: DataFrame, columns: Sequence[str] | None = None, bits: int = 14) -> DataFrame:
    """(column, sketch): a mergeable sketch of each column's distinct values, to be stored beside a snapshot."""
    columns = list(df.columns) if columns is None else list(columns)
    require(df, *columns)
    row = df.agg(*[F.hll_sketch_agg(cell_text(df, c), F.lit(bits)).alias(f"s{i}") for i, c in enumerate(columns)])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def merged_distinct(sketches: DataFrame) -> DataFrame:
    """(column, distinct_values): estimates over all tables whose sketches are in (column, sketch), within 2 %."""
    merged = sketches.groupBy("column").agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select("column", F.hll_sketch_estimate("sketch").alias("distinct_values"))


def data_summary(df: DataFrame) -> DataFrame:
    """Long form (column, metric, value): shape, duplicates, and per column its type, class and nulls."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(missing(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    )
    numbers, texts = set(numeric_columns(df)), set(text_columns(df))

    def cell(column: str | None, metric: str, value: Column) -> Column:
        return F.struct(
            F.lit(column).cast("string").alias("column"), F.lit(metric).alias("metric"),
            value.cast("string").alias("value"),
        )

    cells = [cell(None, "rows", F.col("rows")), cell(None, "columns", F.lit(len(df.columns)))]
    for i, (c, dtype) in enumerate(df.dtypes):
        kind = "numeric" if c in numbers else "categorical" if c in texts else "other"
        cells += [
            cell(c, "dtype", F.lit(dtype)), cell(c, "class", F.lit(kind)), cell(c, "nulls", F.col(f"c{i}"))
        ]
    long = counted.select(F.explode(F.array(*cells)).alias("x")).select("x.*")
    repeated = duplicate_count(df).select(
        F.lit(None).cast("string").alias("column"), F.lit("duplicate_rows").alias("metric"),
        F.col("duplicates").cast("string").alias("value"),
    )
    return long.unionByName(repeated)


def version_statistics(df: DataFrame) -> DataFrame:
    """(column, mean, std, nulls); mean and sample std for numeric columns only."""
    numbers = set(numeric_columns(df))
    cells = []
    for i, c in enumerate(df.columns):
        v = double(df, c) if c in numbers else F.lit(None).cast("double")
        cells.append(
            F.struct(
                F.lit(c).alias("column"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                F.count_if(missing(df, c)).alias("nulls"),
            ).alias(f"c{i}")
        )
    row = df.agg(*cells)
    return row.select(F.explode(F.array(*[f"c{i}" for i in range(len(cells))])).alias("x")).select("x.*")


def target_mean(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean of y per value of x, highest first, null x left out."""
    require(df, x)
    require_numeric(df, y)
    means = df.where(~missing(df, x)).groupBy(col(x).alias("x")).agg(F.avg(double(df, y)).alias("mean_y"))
    return means.orderBy(F.desc("mean_y"), F.asc("x"))


def numeric_ranges(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, range, ratio) where ratio = largest / smallest range, null if the smallest is zero."""
    columns = numeric_columns(df) if columns is None else list(columns)
    if not columns:
        raise ValueError("no numeric column")
    row = df.agg(*[(F.max(double(df, c)) - F.min(double(df, c))).alias(f"c{i}") for i, c in enumerate(columns)])
    ranges = [F.col(f"c{i}") for i in range(len(columns))]
    widest, narrowest = (F.array_max(F.array(*ranges)), F.array_min(F.array(*ranges)))
    ratio = F.when(narrowest != 0, widest / narrowest)
    cells = [F.struct(F.lit(c).alias("column"), r.alias("range"), ratio.alias("ratio")) for c, r in zip(columns, ranges)]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def iqr_outlier_pct(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 1.5) -> DataFrame:
    """(column, outliers, outlier_pct): share of all rows outside the quartile fences."""
    from .clean import iqr_fences

    columns = numeric_columns(df) if columns is None else list(columns)
    fences = iqr_fences(df, columns, threshold)
    cells = []
    for i, c in enumerate(columns):
        lo, hi = fences[c]
        v = double(df, c)
        outside = F.lit(False) if lo is None else (v < F.lit(lo)) | (v > F.lit(hi))
        cells.append(
            F.struct(
                F.lit(c).alias("column"), F.count_if(outside).alias("outliers"),
                F.try_divide(F.count_if(outside) * 100, F.count(F.lit(1))).alias("outlier_pct"),
            ).alias(f"c{i}")
        )
    row = df.agg(*cells)
    return row.select(F.explode(F.array(*[f"c{i}" for i in range(len(cells))])).alias("x")).select("x.*")


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """The first rows along an order, with the full row count beside them."""
    if not 1 <= n <= 100:
        raise ValueError("preview shows between 1 and 100 rows")
    total = df.count()
    ordered = df.orderBy(*[col(c) for c in order_by]) if order_by else df
    return ordered.limit(n).withColumn("total_rows", F.lit(total).cast("long"))


def table_checksum(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """Order-free digest: row count and the sum of the leading 60 bits of each row's md5."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns])
    head = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(head).cast("string").alias("checksum"))
