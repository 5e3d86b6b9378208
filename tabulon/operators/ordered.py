"""Running values over a table order, without a single-task window.

Rows are range-partitioned on (keys, order) and frozen, each partition computes its own running
value, and the small table of per-partition totals supplies what came before. A hot key simply spans
several ranges, so it never lands in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import col, require, unused
from ..session import freeze

SMALL_ROWS = 200_000
ROWS_PER_RANGE = 5_000_000


def _null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join that also matches null keys."""
    renamed = {k: f"__r_{k}" for k in on}
    right = right.withColumnsRenamed(renamed)
    condition = None
    for k, r in renamed.items():
        match = col(k).eqNullSafe(col(r))
        condition = match if condition is None else condition & match
    return left.join(right, condition, how).drop(*renamed.values())


def _ranges(df: DataFrame, sort: Sequence[Column], part: str, rows: int, ranges: int | None) -> DataFrame:
    """Range-partition and write; beyond what the session's partition number holds, by a fixed range size."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if ranges is None and rows > partitions * ROWS_PER_RANGE:
        ranges = -(-rows // ROWS_PER_RANGE)
    spread = df.repartitionByRange(ranges, *sort) if ranges else df.repartitionByRange(*sort)
    return freeze(spread.withColumn(part, F.spark_partition_id()), "ranges")


def running_sums(
    df: DataFrame,
    order: Sequence[Column],
    sums: dict[str, str],
    keys: Sequence[str] = (),
    small: int = SMALL_ROWS,
    ranges: int | None = None,
    frozen: bool = False,
) -> DataFrame:
    """Add ``{new: column}`` running totals (current row included) within ``keys``.

    ``order`` must be a total order within the keys. The input, usually an aggregate, is written once
    because sizing, sampling and summing it would otherwise compute it three times; a caller that has
    written it already says ``frozen``.
    """
    require(df, *keys, *sums.values())
    df = df if frozen else freeze(df, "running")
    by = [col(k) for k in keys]
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.count()
    if rows <= small:
        return df.withColumns({new: F.sum(col(c)).over(frame) for new, c in sums.items()})

    part = unused(df.columns, "__part")
    spread = _ranges(df, [*by, *order], part, rows, ranges)
    totals = spread.groupBy(*by, part).agg(*[F.sum(col(c)).alias(f"__t_{new}") for new, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *by, part, *[F.coalesce(F.sum(f"__t_{new}").over(earlier), F.lit(0)).alias(f"__b_{new}") for new in sums]
    )
    inside = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = spread.withColumns({new: F.sum(col(c)).over(inside) for new, c in sums.items()})
    joined = _null_safe(local, before, [*keys, part])
    return joined.withColumns({new: col(new) + F.col(f"__b_{new}") for new in sums}).drop(
        part, *[f"__b_{new}" for new in sums]
    )


def row_numbers(df: DataFrame, order: Sequence[Column], name: str, keys: Sequence[str] = (), **options) -> DataFrame:
    """Number rows 1.. within ``keys`` along ``order``."""
    one = unused(df.columns, "__one")
    numbered = running_sums(df.withColumn(one, F.lit(1).cast("long")), order, {name: one}, keys, **options)
    return numbered.drop(one)


def fill(
    df: DataFrame,
    column: str,
    order_by: Sequence[str],
    keys: Sequence[str] = (),
    backward: bool = False,
    value: Column | None = None,
    small: int = SMALL_ROWS,
    ranges: int | None = None,
) -> DataFrame:
    """Carry the last (or, backward, the next) present value along the order."""
    require(df, column, *order_by, *keys)
    value = col(column) if value is None else value
    by = [col(k) for k in keys]
    forward_order = [col(o).asc_nulls_first() for o in order_by]
    walk = [col(o).desc_nulls_last() for o in order_by] if backward else forward_order
    frame = Window.partitionBy(*by).orderBy(*walk).rowsBetween(Window.unboundedPreceding, 0)
    names = df.columns
    rows = df.count()
    if rows <= small:
        return df.withColumn(column, F.last(value, ignorenulls=True).over(frame))

    part, carried = unused(names, "__part"), unused(names, "__carried")
    spread = _ranges(df.withColumn(column, value), [*by, *forward_order], part, rows, ranges)
    inside = Window.partitionBy(*by, part).orderBy(*walk).rowsBetween(Window.unboundedPreceding, 0)
    local = spread.withColumn(column, F.last(col(column), ignorenulls=True).over(inside))
    # the last present value of a range is the one with the greatest (least) order key
    position = F.struct(*[col(o) for o in order_by])
    pick = F.min_by if backward else F.max_by
    ends = spread.where(col(column).isNotNull()).groupBy(*by, part).agg(
        pick(col(column), position).alias("__end")
    )
    parts = spread.select(*by, part).distinct()
    known = _null_safe(parts, ends, [*keys, part])
    toward = F.col(part).desc() if backward else F.col(part).asc()
    earlier = Window.partitionBy(*by).orderBy(toward).rowsBetween(Window.unboundedPreceding, -1)
    before = known.select(*by, part, F.last("__end", ignorenulls=True).over(earlier).alias(carried))
    joined = _null_safe(local, before, [*keys, part])
    return joined.withColumn(column, F.coalesce(col(column), F.col(carried))).select(*[col(n) for n in names])
