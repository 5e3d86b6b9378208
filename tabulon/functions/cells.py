"""Cells of several columns, combined inside each batch before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .columns import is_float, present


def cell_text(df: DataFrame, name: str) -> Column:
    """Text that is equal for equal values; NaN counts as missing, both zeros are one."""
    value = present(df, name)
    return (value + F.lit(0.0) if is_float(df, name) else value).cast("string")


def distinct_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(c, value): the distinct present values of each column as text, ``c`` its place in ``columns``."""
    schema = pa.schema([("c", pa.int32()), ("value", pa.large_string())])

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_columns):
                values = batch.column(i).drop_null().unique().cast(pa.large_string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), i, np.int32)), values], schema=schema)

    texts = df.select(*[cell_text(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
    return texts.mapInArrow(unique, "c int, value string").distinct()


def pair_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x, y, u, v, o): how often the values u and v of two columns meet, for every pair of text columns."""
    schema = pa.schema([("x", pa.int32()), ("y", pa.int32()), ("u", pa.large_string()), ("v", pa.large_string()), ("o", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = [batch.column(i).cast(pa.large_string()).dictionary_encode() for i in range(batch.num_columns)]
            codes = [np.asarray(pc.fill_null(c.indices, -1), np.int64) for c in coded]
            for a, b in combinations(range(len(coded)), 2):
                both = (codes[a] >= 0) & (codes[b] >= 0)
                wide = max(1, len(coded[b].dictionary))
                cells, n = np.unique(codes[a][both] * wide + codes[b][both], return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(n), a, np.int32)), pa.array(np.full(len(n), b, np.int32)), coded[a].dictionary.take(pa.array(cells // wide)),
                    coded[b].dictionary.take(pa.array(cells % wide)), pa.array(n, pa.int64()),
                ], schema=schema)

    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(f"v{i}") for i, c in enumerate(columns)])
    met = texts.mapInArrow(count, "x int, y int, u string, v string, o long").groupBy("x", "y", "u", "v").agg(F.sum("o").alias("o"))
    names = F.array(*[F.lit(c) for c in columns])
    return met.select(names[F.col("x")].alias("x"), names[F.col("y")].alias("y"), "u", "v", "o")
