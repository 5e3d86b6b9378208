"""Joining a large table to a fitted or keyed side table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col, unused
from ..session import freeze

BROADCAST_ROWS = 200_000
SALTS = 32


def lookup_join(
    df: DataFrame,
    side: DataFrame,
    on: Sequence[str],
    derived: bool = True,
    broadcast_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Left equi-join to a side table that is unique on ``on``.

    A ``derived`` side is written once, so that counting it does not compute it a second time. A
    counted, small side is broadcast. Otherwise both sides are shuffled; keys that hold more than a
    quarter of a task's fair share are spread over ``salts`` parts, for which only their few side rows
    are copied.
    """
    on = list(on)
    side = freeze(side, "side") if derived else side
    outputs = [*[col(c) for c in df.columns], *[col(c) for c in side.columns if c not in on]]
    if side.count() <= broadcast_rows:
        return df.join(F.broadcast(side), on, "left").select(*outputs)

    counts = df.groupBy(*[col(c) for c in on]).agg(F.count(F.lit(1)).alias("__n"))
    limit = df.count() // (4 * salts) + 1
    hot = counts.where(F.col("__n") > limit).select(*[col(c) for c in on], F.lit(True).alias("__hot")).collect()
    if not hot:
        return df.join(side, on, "left").select(*outputs)
    # fewer than 4 * salts keys can be that large
    keys = F.broadcast(df.sparkSession.createDataFrame(hot, counts.select(*on, F.lit(True).alias("__hot")).schema))
    salt = unused([*df.columns, *side.columns], "__salt")
    rest = [c for c in df.columns if c not in on] or on
    spread = F.pmod(F.xxhash64(*[col(c) for c in rest]), F.lit(salts)).cast("int")
    left = df.join(keys, on, "left").withColumn(salt, F.when(F.col("__hot"), spread).otherwise(0)).drop("__hot")
    last = F.when(F.col("__hot"), F.lit(salts - 1)).otherwise(0)
    right = side.join(keys, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), last))).drop("__hot")
    return left.join(right, [*on, salt], "left").select(*outputs)
