"""Scoring a stream of records with a trained model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..models.training import FittedModel


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Parquet files arriving in a folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def score_stream(stream: DataFrame, model: FittedModel) -> DataFrame:
    """Stateless: every record is scored on its own. Nearest-neighbour models need the batch path."""
    if model.reference is not None:
        raise ValueError("nearest-neighbour models cannot score a stream")
    return model.transform(stream)


def write_stream(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Append to Parquet, exactly once, working off what is available and then stopping."""
    return (
        stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
