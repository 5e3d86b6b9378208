"""Streaming jobs run to completion over the given files."""

from pyspark.sql import functions as F

from ..models.training import fit_model
from ..session import scratch_path
from ..streaming.monitor import request_windows
from ..streaming.score import read_stream, score_stream, write_stream
from .base import Tables, query, rounded
from .modelling import LINEAR_SQL


def _run(t: Tables, stream, label: str):
    path = scratch_path(t.spark, label)
    write_stream(stream, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{path}/rows")


@query("stream_score", LINEAR_SQL)
def stream_score(t: Tables):
    model = fit_model(t.lineitem, "l_extendedprice", "linear_regression", None, ["l_quantity"])
    lines = read_stream(t.spark, t.folder, t.lineitem.schema, "lineitem.parquet")
    scored = _run(t, score_stream(lines, model), "scored")
    return rounded(scored.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "prediction"), 3)


@query(
    "stream_request_stats",
    """SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, requests, mean_latency, error_rate, error_rate > 0.05 AS alert
       FROM (SELECT date_trunc('hour', ts) AS window_start, count(*) AS requests, round(avg(value), 4) AS mean_latency,
                    round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 4) AS error_rate FROM events GROUP BY 1)
       WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
)
def stream_request_stats(t: Tables):
    events = read_stream(t.spark, t.folder, t.events.schema, "events.parquet")
    log = events.withColumn("success", F.col("event_type") != "error")
    out = _run(t, request_windows(log, "ts", "value", "success"), "windows")
    stamps = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return rounded(out.withColumns(stamps))


@query(
    "request_windows",
    """SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, requests, mean_latency, error_rate, error_rate > 0.05 AS alert
       FROM (SELECT date_trunc('hour', ts) AS window_start, count(*) AS requests, round(avg(value), 4) AS mean_latency,
                    round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 4) AS error_rate FROM events GROUP BY 1)""",
)
def request_windows_query(t: Tables):
    log = t.events.withColumn("success", F.col("event_type") != "error")
    out = request_windows(log, "ts", "value", "success")
    stamps = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return rounded(out.withColumns(stamps))
