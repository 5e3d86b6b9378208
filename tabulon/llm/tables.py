"""Small shared helpers: reading, freezing, batching of texts."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import freeze

#: Bytes of text, and texts, that one vectorised step takes at once; a longer single text is taken alone.
STEP_BYTES, STEP_ROWS = 512 << 10, 1024
#: Bytes of the batches in which Spark passes rows to Python workers: buffers of both sides grow with it.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From now on, rows reach Python workers in batches of at most BATCH_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker; functions travel by value, so module globals don't."""
    return vars(sys.modules.setdefault("_tabulon_worker", types.ModuleType("_tabulon_worker")))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in one array and the offsets of each text; a null counts as an empty text."""
    if pa.types.is_null(texts.type):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes and at most ``STEP_ROWS`` texts each."""
    if not batch.num_rows:
        return
    _, offsets = text_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, at + STEP_ROWS)
        yield batch.slice(at, to - at)
        at = to


__all__ = ["STEP_BYTES", "freeze", "shuffle_partitions", "small_batches", "steps", "table", "text_buffers", "worker_state"]
