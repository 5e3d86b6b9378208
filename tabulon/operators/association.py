"""Relations between columns: correlation, contingency tables, chi-square."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.cells import pair_cells
from ..functions.columns import col, double, missing, numeric_columns, require, require_numeric, text_columns
from ..functions.probability import chi2_pvalue
from ..session import freeze

MAX_LEVELS = 1000


def correlation(a: Column, b: Column) -> Column:
    """Pearson over rows where both are present; null, not an error, for a constant side."""
    spread = F.stddev_pop(F.when(b.isNotNull(), a)) * F.stddev_pop(F.when(a.isNotNull(), b))
    return F.try_divide(F.covar_pop(a, b), spread)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, batch: int = 200) -> DataFrame:
    """(x, y, correlation): Pearson over pairwise complete rows, every ordered pair.

    All pairs share a scan; very wide tables take one scan per ``batch`` pairs.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    require_numeric(df, *columns)
    if not columns:
        raise ValueError("no numeric column")
    values = {c: double(df, c) for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    rows = None
    for start in range(0, len(pairs), batch):
        chunk = pairs[start:start + batch]
        row = df.agg(*[correlation(values[a], values[b]).alias(f"c{i}") for i, (a, b) in enumerate(chunk)])
        cells = []
        for i, (a, b) in enumerate(chunk):
            for x, y in dict.fromkeys([(a, b), (b, a)]):
                cells.append(
                    F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"c{i}").alias("correlation"))
                )
        part = row.select(F.explode(F.array(*cells)).alias("p")).select("p.*")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def crosstab(df: DataFrame, x: str, y: str, limit: int = MAX_LEVELS) -> DataFrame:
    """(x, y, count), zero-filled over all level combinations; null keys left out.

    One aggregate counts the pairs that occur; the levels come from it, and the others are zero.
    """
    require(df, x, y)
    present = df.where(~missing(df, x) & ~missing(df, y))
    counts = freeze(present.groupBy(col(x).alias("x"), col(y).alias("y")).agg(F.count(F.lit(1)).alias("count")), "pairs")
    levels = [r["y"] for r in counts.select("y").distinct().limit(limit + 1).collect()]
    if len(levels) > limit:
        raise ValueError(f"column {y} has more than {limit} categories")
    kind = counts.schema["y"].dataType
    every = F.array(*[F.lit(v).cast(kind) for v in levels]).cast(T.ArrayType(kind))
    full = counts.select("x").distinct().select("x", F.explode(every).alias("y"))
    return full.join(counts, ["x", "y"], "left").select("x", "y", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def chi2_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(x, y, chi2, dof) per ordered pair of distinct text columns, Yates-corrected for one degree of freedom.

    All pairs are counted from one scan: each batch of rows combines its equal cells, and only those are shuffled. An
    empty cell contributes its expectation, so none has to be written out.
    """
    columns = text_columns(df) if columns is None else list(columns)
    require(df, *columns)
    if len(columns) < 2:
        raise ValueError("chi-square needs at least 2 categorical columns")
    cells = pair_cells(df, columns).withColumn("o", F.col("o").cast("double"))
    cells = freeze(cells, "cells")  # the counts are read four times, the table once
    rows = cells.groupBy("x", "y", "u").agg(F.sum("o").alias("r"))
    cols = cells.groupBy("x", "y", "v").agg(F.sum("o").alias("c"))
    totals = rows.groupBy("x", "y").agg(F.sum("r").alias("n"), F.count(F.lit(1)).alias("k1")).join(
        cols.groupBy("x", "y").agg(F.count(F.lit(1)).alias("k2")), ["x", "y"]
    )
    # totals holds one row per column pair
    full = cells.join(rows, ["x", "y", "u"]).join(cols, ["x", "y", "v"]).join(F.broadcast(totals), ["x", "y"])
    e = F.col("r") * F.col("c") / F.col("n")
    gap = F.col("o") - e
    dof = ((F.col("k1") - 1) * (F.col("k2") - 1)).cast("long")
    core = full.groupBy("x", "y", "n", "k1", "k2").agg(
        F.sum(gap * gap / e).alias("plain"), F.max(F.abs(gap)).alias("gap"),
        F.sum(e).alias("seen"), F.count(F.lit(1)).alias("filled"),
    )
    # every empty cell adds its expectation
    empty = F.when(F.col("filled") == F.col("k1") * F.col("k2"), 0.0).otherwise(F.col("n") - F.col("seen"))
    plain = F.col("plain") + empty
    # a 2 x 2 table has the same gap in all four cells, so shrinking it scales the statistic
    shrink = F.when(F.col("gap") > 0.5, F.pow(1 - 0.5 / F.col("gap"), 2)).otherwise(0.0)
    out = core.select(
        "x", "y",
        F.when(dof == 0, F.lit(0.0)).when(dof == 1, plain * shrink).otherwise(plain).alias("chi2"),
        dof.alias("dof"),
    )
    both = F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    return out.select(F.explode(both).alias("pair"), "chi2", "dof").select("pair.x", "pair.y", "chi2", "dof")


def chi2_pvalues(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(x, y, p_value) for every ordered pair of text columns, 1.0 on the diagonal."""
    columns = text_columns(df) if columns is None else list(columns)
    stats = chi2_statistics(df, columns).select("x", "y", chi2_pvalue("chi2", "dof").alias("p_value"))
    cells = [F.struct(F.lit(c).alias("x"), F.lit(c).alias("y"), F.lit(1.0).alias("p_value")) for c in columns]
    diagonal = df.sparkSession.range(1).select(F.explode(F.array(*cells)).alias("p")).select("p.*")
    return stats.unionByName(diagonal)
