"""Versions, snapshots, leaderboards, streams."""

import datetime as dt

from pyspark.sql import functions as F

from tabulon.models.training import fit_model
from tabulon.operators.requests import request_assessment
from tabulon.operators.validate import performance_gate
from tabulon.operators.versions import (
    compare_models, keep_latest_n, latest_version, model_run_metrics, next_version_of, select_model,
)
from tabulon.sources.snapshots import current_version, registry, snapshot_dataset
from tabulon.streaming.monitor import request_windows
from tabulon.streaming.score import read_stream, score_stream, write_stream


def test_next_version(spark):
    df = spark.createDataFrame([(None, "V1"), ("V1", "V2"), ("V2", "V2.1"), ("V2.1", "V2.2"), ("V2.9", "V2.10")], "v string, e string")
    assert df.where(next_version_of(F.col("v")) != F.col("e")).count() == 0


def day(n):
    return dt.datetime(2024, 1, n)


def test_latest_and_retention(spark):
    rows = [(i, "p", "d" if i < 7 else "e", day(i), i == 2) for i in range(1, 10)]
    df = spark.createDataFrame(rows, "id int, project string, name string, created timestamp, cur boolean")
    newest = latest_version(df, ["project", "name"], "created", "id", "cur").orderBy("name").collect()
    assert [r["id"] for r in newest] == [2, 9]
    kept = keep_latest_n(df, ["project", "name"], "created", "id", 2).where("keep").orderBy("id").collect()
    assert [r["id"] for r in kept] == [5, 6, 8, 9]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "store")
    df = spark.createDataFrame([("John", 25, 50000), ("Jane", 30, 60000)], "name string, age long, salary long")
    first = snapshot_dataset(df, root, "p", "staff")
    second = snapshot_dataset(df.orderBy("salary", ascending=False), root, "p", "staff", tag="preprocessed", make_current=False)
    third = snapshot_dataset(df.limit(1), root, "p", "staff", make_current=False)
    assert [x["version"] for x in (first, second, third)] == ["V1", "V2", "V2.1"]
    assert first["checksum"] == second["checksum"] != third["checksum"]
    assert first["schema_info"] == {"name": "string", "age": "bigint", "salary": "bigint"} and first["size_bytes"] > 0
    assert registry(spark, root).count() == 3
    assert current_version(spark, root, "p", "staff").first()["version"] == "V1"
    assert registry(spark, str(tmp_path / "none")).count() == 0


def test_leaderboard(spark):
    rows = [
        (1, {"f1": 0.9, "acc": 0.9}, day(31), 10), (2, {"f1": 0.95, "acc": 0.5}, day(31), 10),
        (3, {"acc": 0.9}, day(31), 10), (4, {"f1": 0.92, "acc": 0.9}, day(31), 999 * 1024 * 1024),
        (5, {"f1": 0.91, "acc": 0.9}, dt.datetime(2023, 11, 1), 10),
    ]
    df = spark.createDataFrame(rows, "id int, metrics map<string,double>, created_at timestamp, size_bytes long")
    out = compare_models(df, "f1", 0.85, {"acc": 0.8}, F.to_date(F.lit("2024-01-31")), 100)
    found = {r["id"]: r for r in out.collect()}
    assert abs(found[1]["score"] - 1.0) < 1e-12 and abs(found[5]["score"] - 0.91) < 1e-12
    assert {k for k, r in found.items() if r["is_eligible"]} == {1, 5}
    assert found[3]["eligibility_reasons"] == ["Primary metric f1 below threshold"]
    assert select_model(out, "id").first()["id"] == 1
    assert select_model(out, "id", manual=3).first()["id"] == 3


def test_run_metrics_win(spark):
    models = spark.createDataFrame(
        [(1, 10, "active", {"a": 1.0, "b": 2.0}), (2, 99, "active", None), (3, 10, "old", {"a": 1.0})],
        "id int, run_id int, status string, metrics map<string,double>",
    )
    runs = spark.createDataFrame([(10, {"b": 5.0, "c": 6.0})], "run_id int, metrics map<string,double>")
    out = {r["id"]: r["all_metrics"] for r in model_run_metrics(models, runs).collect()}
    assert out == {1: {"a": 1.0, "b": 5.0, "c": 6.0}, 2: {}}


def test_gate(spark):
    df = spark.createDataFrame(
        [("classification", {"accuracy": 0.9}), ("regression", {"mse": 0.5}), ("regression", {}), ("classification", {"f1_score": 0.2, "accuracy": 1.0})],
        "task string, metrics map<string,double>",
    )
    assert [r["passed"] for r in performance_gate(df).collect()] == [True, True, False, False]


def test_assessment(spark):
    df = spark.createDataFrame([(0.5, True)] * 9 + [(0.5, False)], "t double, ok boolean")
    row = request_assessment(df, "t", "ok").first()
    assert (row["assessment"], row["verdict"]) == ("GOOD", "PASS")
    assert request_assessment(df.where("false"), "t", "ok").count() == 1


def test_stream_scores_equal_batch(spark, folder, tmp_path):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    model = fit_model(lines, "l_extendedprice", "ridge", None, ["l_quantity", "l_tax"])
    stream = score_stream(read_stream(spark, folder, lines.schema, "lineitem.parquet"), model)
    write_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(got.collect(), key=str) == sorted(model.transform(lines).collect(), key=str)


def test_late_rows_are_dropped(spark, tmp_path):
    source, schema = tmp_path / "in", "ts timestamp, value double, ok boolean"

    def put(rows, n):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source / f"d={n}"))

    def run():
        stream = read_stream(spark, str(source / "d=*"), schema)
        write_stream(request_windows(stream, "ts", "value", "ok"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()

    put([(dt.datetime(2024, 1, 1, 0, 5), 1.0, True), (dt.datetime(2024, 1, 1, 0, 6), 3.0, False), (dt.datetime(2024, 1, 1, 5), 1.0, True)], 1)
    run()
    put([(dt.datetime(2024, 1, 1, 0, 7), 100.0, True), (dt.datetime(2024, 1, 1, 9), 1.0, True)], 2)
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()
    assert [(r["requests"], r["mean_latency"], r["error_rate"], r["alert"]) for r in rows][0] == (2, 2.0, 0.5, True)
    assert len(rows) == 2
