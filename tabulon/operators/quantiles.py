"""Exact order statistics of typed columns.

The cells of all columns are counted by value, so that a value held by a third of the rows is one row. The counts are
range-partitioned once by (group, column, value); the totals of the ranges tell in which one a rank lies, and a running count
inside that range picks it. Whole numbers and decimals keep their type: nothing becomes a double on the way. Inputs
counted as small skip the partitioning.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import col, double, require, require_numeric
from ..session import freeze

SMALL_VALUES = 4_000_000  # cells, over all columns, that are not partitioned by range
MAX_GROUPS = 10_000
RANGE_CELLS = 2_000_000

#: share of rows, and the 0-based position wanted among n values
Target = tuple[float, Callable[[int], float]]


def share(p: float) -> Target:
    """Linear interpolation between neighbours, position (n - 1) * p."""
    return p, lambda n: (n - 1) * p


def _typed(df: DataFrame, name: str) -> Column:
    """The column in the widest type of its kind; NaN counts as missing."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DecimalType):
        return col(name)
    return col(name).cast("long") if isinstance(kind, T.IntegralType) else double(df, name)


def order_statistics(
    df: DataFrame,
    wanted: dict[str, Sequence[Target]],
    keys: Sequence[str] = (),
    small: int | None = None,
    max_groups: int = MAX_GROUPS,
    ranges: int | None = None,
) -> dict[tuple, dict[str, tuple[int, list]]]:
    """{group: {column: (non-null count, values at the wanted positions)}}; nulls and NaN ignored.

    A position between two ranks interpolates. Values of whole-number columns are ``int``, of decimal columns ``Decimal``
    (interpolated whole numbers are ``float``). ``small`` overrides the number of cells that need no ranges, ``ranges``
    their number.
    """
    names = list(wanted)
    require(df, *keys)
    require_numeric(df, *names)
    groups = [f"g{i}" for i in range(len(keys))]
    base = df.select(*[df[k].alias(g) for k, g in zip(keys, groups)], *[_typed(df, c).alias(f"v{i}") for i, c in enumerate(names)])
    counted = base.groupBy(*groups).agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))])
    summary = counted.limit(max_groups + 1).collect()
    if len(summary) > max_groups:
        raise ValueError(f"more than {max_groups} groups")

    result: dict[tuple, dict[str, tuple[int, list]]] = {}
    places: dict[tuple, dict[int, list[float]]] = {}  # positions by group and column
    for row in summary:
        group = tuple(row[g] for g in groups)
        result[group], places[group] = {}, {}
        for i, name in enumerate(names):
            n = row[f"n{i}"]
            result[group][name] = (n, [None] * len(wanted[name]))
            if n:
                places[group][i] = [min(n - 1, max(0, position(n))) for _, position in wanted[name]]
    limit = SMALL_VALUES if small is None else small
    for columns in _by_type(base, len(names)):
        cells = sum(row[f"n{i}"] for row in summary for i in columns)
        ranks = {
            (*group, i): sorted({r for at in per[i] for r in (math.floor(at), math.ceil(at))})
            for group, per in places.items() for i in columns if i in per
        }
        if not ranks:
            continue
        found = _picked(base, groups, columns, ranks, cells, None if cells <= limit else ranges or max(2, cells // RANGE_CELLS))
        for (*group, i), values in found.items():
            out = result[tuple(group)][names[i]][1]
            for j, at in enumerate(places[tuple(group)][i]):
                out[j] = _between(values[math.floor(at)], values[math.ceil(at)], at - math.floor(at))
    return result


def _between(low, high, part: float):
    if part == 0 or low == high:
        return low
    if isinstance(low, Decimal):
        with localcontext(prec=76):  # twice the digits of the widest column
            return low + (high - low) * Decimal(part)
    return low + (high - low) * part


def _by_type(base: DataFrame, n: int) -> list[list[int]]:
    """The columns that share a type go through one job."""
    kinds: dict[str, list[int]] = {}
    for i in range(n):
        kinds.setdefault(base.schema[f"v{i}"].dataType.simpleString(), []).append(i)
    return list(kinds.values())


def counted_cells(base: DataFrame, groups: list[str], columns: list[int]) -> DataFrame:
    """(groups..., c column, v value, n): every present cell, equal ones counted together before anything is shuffled.

    Without groups each batch of rows is counted on its own, so that a value comes up once a batch; with groups, or for
    decimals, cells are counted by value over all rows.
    """
    if groups or not isinstance(base.schema[f"v{columns[0]}"].dataType, (T.LongType, T.DoubleType)):
        each = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"v{i}").alias("v")) for i in columns])
        long = base.select(*groups, F.explode(each).alias("x")).select(*groups, "x.c", "x.v")
        return long.where("v IS NOT NULL").groupBy(*groups, "c", "v").agg(F.count(F.lit(1)).alias("n"))
    whole = isinstance(base.schema[f"v{columns[0]}"].dataType, T.LongType)
    kind = pa.int64() if whole else pa.float64()
    schema = pa.schema([("c", pa.int32()), ("v", kind), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in columns:
                values, n = np.unique(batch.column(f"v{i}").drop_null().to_numpy(zero_copy_only=False), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), i, np.int32)), pa.array(values, kind), pa.array(n, pa.int64())], schema=schema)

    return base.select(*[f"v{i}" for i in columns]).mapInArrow(count, f"c int, v {'long' if whole else 'double'}, n long")


def _picked(
    base: DataFrame, groups: list[str], columns: list[int], ranks: dict[tuple, list[int]], cells: int, ranges: int | None
) -> dict[tuple, dict[int, object]]:
    """{(group..., column): {rank: value}}; ``ranges`` is None for an input that needs none."""
    spark = base.sparkSession
    counts, keys = counted_cells(base, groups, columns), [*groups, "c"]
    if ranges is None:
        counts = counts.withColumn("part", F.lit(0))
        wanted = [(0, *key, 0, own) for key, own in ranks.items()]
    else:
        dealt = counts.repartitionByRange(ranges, *keys, "v").withColumn("part", F.spark_partition_id())
        counts = freeze(dealt, "ranges")
        # at most a row for each range, and one more for each group and column
        totals = counts.groupBy("part", *keys).agg(F.sum("n").alias("n")).orderBy("part").collect()
        before: dict[tuple, tuple[list[int], list[int]]] = {}
        for r in totals:
            parts, ends = before.setdefault(tuple(r[k] for k in keys), ([], [0]))
            parts.append(r["part"])
            ends.append(ends[-1] + r["n"])
        inside: dict[tuple, list[int]] = {}
        for key, own in ranks.items():
            parts, ends = before[key]
            for rank in own:
                at = bisect_right(ends, rank) - 1
                inside.setdefault((parts[at], *key, ends[at]), []).append(rank)
        wanted = [(*place, own) for place, own in inside.items()]
    fields = [T.StructField("w_part", T.IntegerType())]
    fields += [T.StructField(f"w_{g}", base.schema[g].dataType) for g in groups]
    fields += [T.StructField("w_c", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("ranks", T.ArrayType(T.LongType()))]
    side = spark.createDataFrame(wanted, T.StructType(fields))  # as many rows as places asked for
    match = F.col("part") == F.col("w_part")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"w_{k}"))
    # a value may have several counts
    running = Window.partitionBy("part", *keys).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("n").over(running) + F.col("before")
    met = counts.where(F.col("part").isin(sorted({w[0] for w in wanted}))).join(F.broadcast(side), match).withColumn("upto", upto)
    here = F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
    rows = met.select(*keys, "v", here.alias("here")).where(F.size("here") > 0).collect()
    found: dict[tuple, dict[int, object]] = {}
    for r in rows:
        found.setdefault(tuple(r[k] for k in keys), {}).update(dict.fromkeys(r["here"], r["v"]))
    return found


def quantiles(
    df: DataFrame, probs: dict[str, Sequence[float]], keys: Sequence[str] = (), typed: bool = False, **options
) -> dict[tuple, dict[str, list]]:
    """{group: {column: exact linearly interpolated quantiles}}; as floats unless ``typed``."""
    found = order_statistics(df, {c: [share(p) for p in ps] for c, ps in probs.items()}, keys, **options)

    def plain(value):
        return value if typed or value is None else float(value)

    return {g: {c: [plain(v) for v in values] for c, (_, values) in per.items()} for g, per in found.items()}


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], typed: bool = False) -> dict[str, list]:
    """Ungrouped quantiles of several columns."""
    if not columns:
        return {}
    return quantiles(df, {c: probs for c in columns}, typed=typed).get((), {c: [None] * len(probs) for c in columns})
