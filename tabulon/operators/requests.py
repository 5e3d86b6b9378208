"""Analysis of a request log (endpoint, status, response time, success, timestamp)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, double, require, require_numeric
from .quantiles import column_quantiles


def request_log_stats(log: DataFrame, latency: str, success: str, ts: str) -> DataFrame:
    """One row: volumes, success rate in percent, latency summary and requests per second."""
    require(log, success, ts)
    require_numeric(log, latency)
    v = double(log, latency)
    median, p95, p99 = column_quantiles(log, [latency], (0.5, 0.95, 0.99))[latency]
    stamp = F.unix_micros(col(ts).cast("timestamp"))
    span = (F.max(stamp) - F.min(stamp)) / 1e6
    n = F.count(F.lit(1))
    return log.agg(
        n.alias("total_requests"), F.count_if(col(success)).alias("successful_requests"),
        F.try_divide(F.count_if(col(success)) * 100, n).alias("success_rate"),
        F.avg(v).alias("mean_latency"), F.lit(median).cast("double").alias("median_latency"),
        F.lit(p95).cast("double").alias("p95_latency"), F.lit(p99).cast("double").alias("p99_latency"),
        F.min(v).alias("min_latency"), F.max(v).alias("max_latency"),
        F.when(span > 0, n / span).otherwise(0.0).alias("requests_per_second"),
    )


def request_endpoint_stats(log: DataFrame, endpoint: str, latency: str, success: str) -> DataFrame:
    v = double(log, latency)
    return log.groupBy(col(endpoint).alias("endpoint")).agg(
        F.round(F.avg(v), 3).alias("mean_latency"), F.round(F.max(v), 3).alias("max_latency"),
        F.round(F.min(v), 3).alias("min_latency"),
        F.round(F.avg(col(success).cast("double")), 3).alias("success_rate"), F.count(F.lit(1)).alias("requests"),
    )


def request_error_counts(log: DataFrame, status: str, success: str) -> DataFrame:
    failed = log.where(~col(success))
    counts = failed.groupBy(col(status).alias("status")).agg(F.count(F.lit(1)).alias("errors"))
    return counts.orderBy(F.desc("errors"), "status")


def assessment(rate: Column, mean: Column) -> Column:
    return (
        F.when((rate >= 95) & (mean < 2.0), "EXCELLENT").when((rate >= 90) & (mean < 5.0), "GOOD")
        .when(rate >= 80, "ACCEPTABLE").otherwise("POOR")
    )


def request_assessment(log: DataFrame, latency: str, success: str) -> DataFrame:
    """One row: success rate, mean latency, the grade and the verdict."""
    rate = F.try_divide(F.count_if(col(success)) * 100, F.count(F.lit(1)))
    row = log.agg(rate.alias("success_rate"), F.avg(double(log, latency)).alias("mean_latency"))
    rate, mean = F.col("success_rate"), F.col("mean_latency")
    verdict = F.when((rate >= 90) & (mean < 5.0), "PASS").otherwise("FAIL")
    return row.withColumns({"assessment": assessment(rate, mean), "verdict": verdict})
