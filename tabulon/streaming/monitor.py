"""Request statistics over a stream of log events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, double, require
from ..operators.validate import ALERT_LIMITS


def request_windows(
    log: DataFrame, ts: str, latency: str, success: str, window: str = "1 hour", watermark: str = "10 minutes",
    error_limit: float = ALERT_LIMITS["error_rate"],
) -> DataFrame:
    """Tumbling-window count, mean latency, error share and alert flag.

    The same plan serves batch and stream; in a stream a window appears once the watermark passes it,
    and rows later than the watermark are dropped.
    """
    require(log, ts, latency, success)
    stamped = log.withColumn("__ts", col(ts).cast("timestamp"))
    if log.isStreaming:
        stamped = stamped.withWatermark("__ts", watermark)
    grouped = stamped.groupBy(F.window("__ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.avg(double(log, latency)).alias("mean_latency"),
        F.avg(_failed(col(success))).alias("error_rate"),
    )
    return grouped.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests", "mean_latency",
        "error_rate", (F.col("error_rate") > error_limit).alias("alert"),
    )


def _failed(success: Column) -> Column:
    return (~success).cast("double")
