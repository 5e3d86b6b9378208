"""Exact-size, repeatable splits.

Rows are ordered by a hash of their key (per class when stratified). The cut points are order
statistics of that hash, found with the sketch-and-count passes of :mod:`quantiles`, so assigning a
row is a column expression: the data is neither sorted nor shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import col, require, unused
from ..functions.hashing import hash_order, key_text
from .quantiles import order_statistics


def hash_cuts(
    df: DataFrame,
    keys: Sequence[str],
    shares: Sequence[float],
    sizes: Callable[[int], list[int]],
    name: str,
    stratify: str | None = None,
    seed: int = 42,
    **options,
) -> DataFrame:
    """Add ``name``: the index of the slice each row falls in along the hash order.

    ``sizes(n)`` gives the running slice ends for a class of ``n`` rows; ``shares`` are their
    approximate fractions. Rows whose hash equals a cut are told apart by their key text.
    """
    require(df, *keys, *([stratify] if stratify else []))
    h, label = unused(df.columns, "__hash"), unused(df.columns, "__class")
    work = df.withColumn(h, hash_order(keys, seed))
    by = []
    if stratify:
        work = work.withColumn(label, col(stratify).cast("string"))
        by = [label]

    def at(i: int) -> Callable[[int], float]:
        return lambda n: max(0, sizes(n)[i] - 1)

    wanted = {h: [(s, at(i)) for i, s in enumerate(shares)]}
    found = order_statistics(work, wanted, by, **options)
    cuts = {}
    for group, per in found.items():
        n, values = per[h]
        ends = sizes(n)
        # an empty slice has its cut before every hash
        cuts[group] = [-1 if e == 0 else int(v) for e, v in zip(ends, values)]

    ties = _tied(work, h, by, keys, cuts, {g: sizes(per[h][0]) for g, per in found.items()})
    cut_names = [f"__cut{i}" for i in range(len(shares))]
    last_names = [f"__last{i}" for i in range(len(shares))]
    text = key_text(keys)
    if by:
        fields = [T.StructField(label, T.StringType())]
        fields += [T.StructField(c, T.LongType()) for c in cut_names]
        fields += [T.StructField(c, T.StringType()) for c in last_names]
        rows = [(g[0], *cuts[g], *ties[g]) for g in cuts]
        side = df.sparkSession.createDataFrame(rows, T.StructType(fields)).withColumnRenamed(label, "__side")
        work = work.join(F.broadcast(side), col(label).eqNullSafe(F.col("__side")), "left").drop("__side")
    else:
        values = cuts.get((), [-1] * len(shares))
        last = ties.get((), [None] * len(shares))
        work = work.withColumns(
            {c: F.lit(v).cast("long") for c, v in zip(cut_names, values)}
            | {c: F.lit(v).cast("string") for c, v in zip(last_names, last)}
        )
    index: Column = F.lit(0)
    for c, last in zip(cut_names, last_names):
        beyond = (col(h) > F.col(c)) | ((col(h) == F.col(c)) & (text > F.col(last)))
        index = index + F.when(beyond, 1).otherwise(0)
    return work.withColumn(name, index.cast("int")).drop(h, label, *cut_names, *last_names)


def _tied(work, h, by, keys, cuts, ends) -> dict[tuple, list[str | None]]:
    """For each cut the last key text still inside, needed only where a hash is shared."""
    values = sorted({v for per in cuts.values() for v in per if v >= 0})
    result = {g: [None] * len(per) for g, per in cuts.items()}
    if not values:
        return result
    at_cut = work.where(col(h).isin(values)).groupBy(*by, col(h).alias("__h")).agg(F.count("*").alias("c"))
    shared = [r for r in at_cut.where("c > 1").collect()]
    for r in shared:
        group = tuple(r[b] for b in by)
        rows = work.where(col(h) == r["__h"])
        for b in by:
            rows = rows.where(col(b).eqNullSafe(F.lit(r[b])))
        below = work.where(col(h) < r["__h"])
        for b in by:
            below = below.where(col(b).eqNullSafe(F.lit(r[b])))
        first = below.count()
        per_key = rows.groupBy(key_text(keys).alias("k")).agg(F.count("*").alias("c"))
        running = per_key.withColumn(
            "upto", F.sum("c").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
        )
        for i, v in enumerate(cuts.get(group, [])):
            if v == r["__h"]:
                inside = running.where(F.col("upto") <= ends[group][i] - first).agg(F.max("k")).first()[0]
                result[group][i] = inside if inside is not None else ""
    return result


def holdout(
    df: DataFrame, keys: Sequence[str], test_size: float = 0.2, stratify: str | None = None, seed: int = 42,
    name: str = "is_test", **options,
) -> DataFrame:
    """Add a 0/1 test flag: the first ceil(p * n) rows of each class along the hash order."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    cut = hash_cuts(df, keys, [test_size], lambda n: [ceil_share(n, test_size)], name, stratify, seed, **options)
    return cut.withColumn(name, (F.lit(1) - col(name)).cast("int"))


def ceil_share(n: int, share: float) -> int:
    return math.ceil(round(n * share, 9))


def three_way(
    df: DataFrame, keys: Sequence[str], test_size: float = 0.2, validation_size: float = 0.2,
    stratify: str | None = None, seed: int = 42, name: str = "part", **options,
) -> DataFrame:
    """Label every row test, validation or train."""
    def ends(n: int) -> list[int]:
        test = ceil_share(n, test_size)
        return [test, min(n, test + ceil_share(n, validation_size))]

    cut = hash_cuts(df, keys, [test_size, test_size + validation_size], ends, name, stratify, seed, **options)
    label = F.when(col(name) == 0, "test").when(col(name) == 1, "validation").otherwise("train")
    return cut.withColumn(name, label)


def fold_column(
    df: DataFrame, keys: Sequence[str], folds: int = 5, stratify: str | None = None, seed: int = 42,
    name: str = "fold", **options,
) -> DataFrame:
    """Fold 0..k-1 of equal size (the first n mod k folds one larger), per class when stratified."""
    if folds < 2:
        raise ValueError("cross-validation needs at least 2 folds")

    def ends(n: int) -> list[int]:
        base, extra = divmod(n, folds)
        return [base * (i + 1) + min(i + 1, extra) for i in range(folds - 1)]

    shares = [(i + 1) / folds for i in range(folds - 1)]
    return hash_cuts(df, keys, shares, ends, name, stratify, seed, **options)


def time_split(df: DataFrame, order: str, test_size: float = 0.2, name: str = "is_test") -> DataFrame:
    """Hold out the rows later than the (1 - p) quantile of the time column."""
    require(df, order)
    stamp = unused(df.columns, "__micros")
    work = df.withColumn(stamp, F.unix_micros(col(order).cast("timestamp")))
    found = order_statistics(work, {stamp: [(1 - test_size, lambda n: max(0, n - ceil_share(n, test_size) - 1))]})
    cut = found[()][stamp][1][0]
    flag = F.lit(0) if cut is None else F.when(col(stamp) > F.lit(int(cut)), 1).otherwise(0)
    return work.withColumn(name, flag.cast("int")).drop(stamp)
