"""Cleaning, imputing, encoding, scaling: edge cases and closed forms."""

import math

import pytest
from pyspark.sql import functions as F

from tabulon.operators.clean import (
    clean_column, clean_numeric, clean_text, dedupe, deletion_report, iqr_filter, split_xy,
)
from tabulon.operators.encode import (
    categories, encode, fit_codes, fit_onehot, label_encode, onehot, ordinal_encode, target_encode,
    target_encode_crossfit,
)
from tabulon.operators.impute import fit_means, impute, impute_table
from tabulon.operators.scale import fit_scaler, scale
from tabulon.sources.files import read_table, write_table


def values(df, column="x"):
    return [r[column] for r in df.select(column).collect()]


@pytest.fixture
def holey(spark):
    return spark.createDataFrame(
        [(1, None, "b"), (2, 4.0, None), (3, float("nan"), "a"), (4, 2.0, "a"), (5, None, "b")],
        "id int, x double, s string",
    )


def test_imputation_methods(holey):
    assert sorted(values(impute(holey, "x", "mean"))) == [2.0, 3.0, 3.0, 3.0, 4.0]
    assert sorted(values(impute(holey, "x", "median"))) == [2.0, 3.0, 3.0, 3.0, 4.0]
    assert sorted(values(impute(holey, "x", "knn"))) == [2.0, 3.0, 3.0, 3.0, 4.0]
    assert values(impute(holey, "s", "mode").orderBy("id"), "s") == ["b", "a", "a", "a", "b"]  # tie: smallest
    assert values(impute(holey, "s", "mean", categorical=True).where("id = 2"), "s") == ["a"]
    assert values(impute(holey, "x", "whatever").where("id = 1")) == [3.0]
    assert sorted(values(impute(holey, "x", "drop"))) == [2.0, 4.0]
    assert values(impute(holey, "x", "forward_fill", order_by=["id"]).orderBy("id")) == [None, 4.0, 4.0, 2.0, 2.0]
    assert values(impute(holey, "x", "backward_fill", order_by=["id"]).orderBy("id")) == [4.0, 4.0, 2.0, 2.0, None]
    with pytest.raises(ValueError):
        impute(holey, "x", "forward_fill")
    with pytest.raises(ValueError):
        impute(holey, "nothing")


def test_imputing_twice_changes_nothing(holey):
    once = impute_table(holey, "mean")
    assert sorted(once.collect()) == sorted(impute_table(once, "mean").collect())
    zero = impute_table(holey, "constant")
    assert sorted(values(zero)) == [0.0, 0.0, 0.0, 2.0, 4.0]


def test_all_missing_column(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b")], "x double, s string")
    assert values(impute(df, "x", "mean")) == [None, None]
    assert values(scale(df, ["x"])) == [None, None]
    assert impute(df.where("false"), "x", "median").count() == 0


def test_cleaning(spark):
    df = spark.createDataFrame([(" a ", 1), ("  ", 2), (None, 3), ("b", 4), ("b", 4)], "s string, n int")
    assert sorted(values(clean_text(df, "s"), "s"), key=str) == ["None" if v is None else v for v in []] + sorted(
        ["a", None, "b"], key=str
    )
    one = spark.createDataFrame([(5.0,)], "x double")
    assert clean_numeric(one, "x").count() == 0  # no sample deviation from one row
    spread = spark.range(100).select(F.when(F.col("id") == 0, 1e6).otherwise(F.col("id")).alias("x"))
    assert clean_column(spread, "x").count() == 99
    same = spark.createDataFrame([(1.0, i) for i in range(5)], "x double, i int")
    assert clean_numeric(same, "x").count() == 5
    assert dedupe(spark.createDataFrame([(None, 1), (None, 1), (2, 1)], "a int, b int")).count() == 2


def test_iqr_cascade_differs_from_single_fit(spark):
    df = spark.range(200).select(
        F.when(F.col("id") < 8, F.col("id") * 1000 + 5000).otherwise(F.col("id") % 10).cast("double").alias("a"),
        F.when(F.col("id") < 60, F.col("id") * 7).otherwise(F.col("id") % 9).cast("double").alias("b"),
    )
    cascade = iqr_filter(df, ["a", "b"])
    after = iqr_filter(iqr_filter(df, ["a"]), ["b"])
    assert sorted(cascade.collect()) == sorted(after.collect())
    assert iqr_filter(df, ["a", "b"], cascade=False).count() != cascade.count()


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    x, y = split_xy(df)
    assert (x.columns, y.columns) == (["a", "b"], ["c"])
    with pytest.raises(ValueError):
        split_xy(df, "z")
    assert deletion_report(df, ["a", "z"]) == {
        "deleted_columns": ["a"], "not_found_columns": ["z"], "shape_before": (1, 3), "shape_after": (1, 2)
    }


def test_encoders(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "it's \\ odd")], "id int, s string")
    hot = onehot(df, "s", drop_first=False)
    assert hot.columns == ["id", "s_a", "s_b", "s_it's \\ odd"]
    assert [tuple(r)[1:] for r in hot.orderBy("id").collect()] == [(0, 1, 0), (1, 0, 0), (0, 0, 0), (0, 0, 1)]
    fitted = fit_onehot(df, "s")
    unseen = spark.createDataFrame([(9, "zz")], "id int, s string")
    assert tuple(fitted.apply(unseen).first())[1:] == (0, 0)
    assert values(ordinal_encode(df, "s").orderBy("id"), "s") == [1, 0, -1, 2]
    assert values(label_encode(df, "s").orderBy("id"), "s") == [1, 0, 3, 2]
    assert values(ordinal_encode(unseen, "s", fit_codes(df, "s")), "s") == [-1]
    with pytest.raises(ValueError):
        encode(df, "s", "binary")
    with pytest.raises(ValueError):
        categories(df, "s", limit=2)


def test_target_encoding_closed_form(spark):
    rows = [("a", 1.0), ("a", 3.0), ("b", 10.0), ("b", 14.0), (None, 2.0), (None, 2.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, s string, y double")
    mean = sum(y for _, y in rows) / 6
    var = sum((y - mean) ** 2 for _, y in rows) / 6
    found = {r["id"]: r["s"] for r in target_encode(df, "s", "y").collect()}

    def expected(ys):
        m = sum(ys) / len(ys)
        within = sum((y - m) ** 2 for y in ys) / len(ys)
        w = var * len(ys) / (var * len(ys) + within)
        return w * m + (1 - w) * mean

    for i, ys in ((0, [1.0, 3.0]), (2, [10.0, 14.0]), (4, [2.0, 2.0])):
        assert math.isclose(found[i], expected(ys), rel_tol=1e-9)
    crossed = target_encode_crossfit(df, "s", "y", ["id"], folds=2)
    assert crossed.where("s IS NULL").count() == 0 and crossed.count() == 6


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5), (None, 5), (6.0, 5)], "x double, c int")
    z = [v for v in values(scale(df, ["x"], "standard")) if v is not None]
    assert math.isclose(sum(z), 0, abs_tol=1e-12) and math.isclose(sum(v * v for v in z) / 3, 1)
    for method, constant in (("z-score", 0.0), ("min-max", 0.0), ("robust", 0.0), ("max-abs", 1.0)):
        assert set(values(scale(df, ["c"], method), "c")) == {constant}
    assert values(scale(df, ["x"], "robust").where("x IS NOT NULL")) == [-0.4, 0.0, 1.6]
    with pytest.raises(ValueError):
        fit_scaler(df, ["x"], "log")
    with pytest.raises(ValueError):
        scale(df.withColumn("s", F.lit("a")), ["s"])


def test_projection_as_stage(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (5.0, None)], "x double, s string")
    for step in (fit_means(df, ["x"]), fit_scaler(df, ["x"]), fit_onehot(df, "s")):
        assert step.stage(df.columns).transform(df).collect() == step.apply(df).collect()


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", all', None), (2, None, 2.5)], "id int, s string, x double")
    for fmt in ("csv", "json", "parquet"):
        path = str(tmp_path / f"t.{fmt}")
        write_table(df, path)
        assert read_table(spark, path, schema=df.schema).orderBy("id").collect() == df.orderBy("id").collect()
        with pytest.raises(Exception):
            write_table(df, path)
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}]')
    assert read_table(spark, str(tmp_path / "a.json"), json_array=True).count() == 2
    with pytest.raises(ValueError):
        read_table(spark, "table.xlsx")
