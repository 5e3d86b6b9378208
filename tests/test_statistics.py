"""Statistics, curves, splits and validation: edge cases and closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions.probability import chi2_tail, kolmogorov_pvalue
from tabulon.operators.association import chi2_pvalues, chi2_statistics, correlation_matrix, crosstab
from tabulon.operators.detect import detect_task
from tabulon.operators.metrics import (
    averaged_metrics, classification_metrics, clustering_metrics, pr_curve, regression_metrics, roc_auc, roc_curve, silhouette, silhouette_by_label,
)
from tabulon.operators.plots import box, density, histogram, pair_points, plot_batch, principal_components, scatter
from tabulon.operators.profile import categorical_topk, data_summary, describe_numeric, duplicate_count, numeric_ranges, preview
from tabulon.operators.select import chi2, feature_scores, mutual_information, select_features
from tabulon.operators.split import fold_column, holdout, three_way, time_split
from tabulon.operators.validate import drift_ks, fairness


def test_chi2_tail_closed_forms():
    assert math.isclose(chi2_tail(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(chi2_tail(5.991464547107979, 2), 0.05, rel_tol=1e-9)
    assert math.isclose(chi2_tail(7.814727903251179, 3), 0.05, rel_tol=1e-9)
    assert math.isclose(chi2_tail(18.307038053275146, 10), 0.05, rel_tol=1e-9)
    assert math.isclose(chi2_tail(24.995790139728616, 15), 0.05, rel_tol=1e-9)
    assert chi2_tail(0.0, 4) == 1.0


def test_two_by_two_is_corrected(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 40
    df = spark.createDataFrame(rows, "u string, v string")
    n, cells = 100, {(10, 30, 40), (20, 30, 60), (30, 70, 40), (40, 70, 60)}
    expected = sum((abs(o - r * c / n) - 0.5) ** 2 / (r * c / n) for o, r, c in cells)
    row = chi2_statistics(df).where("x = 'u'").first()
    assert row["dof"] == 1 and math.isclose(row["chi2"], expected, rel_tol=1e-9)
    p = {(r["x"], r["y"]): r["p_value"] for r in chi2_pvalues(df).collect()}
    assert p["u", "u"] == 1.0 and math.isclose(p["u", "v"], math.erfc(math.sqrt(expected / 2)), rel_tol=1e-9)
    with pytest.raises(ValueError):
        chi2_statistics(df.select("u"))


def test_empty_cells_count(spark):
    rows = [("a", "x")] * 6 + [("b", "y")] * 6 + [("c", "z")] * 6 + [("a", "z")] * 2
    df = spark.createDataFrame(rows, "u string, v string")
    totals_u, totals_v, n = {"a": 8, "b": 6, "c": 6}, {"x": 6, "y": 6, "z": 8}, 20
    seen = {("a", "x"): 6, ("b", "y"): 6, ("c", "z"): 6, ("a", "z"): 2}
    expected = sum(
        (seen.get((u, v), 0) - r * c / n) ** 2 / (r * c / n) for u, r in totals_u.items() for v, c in totals_v.items()
    )
    assert math.isclose(chi2_statistics(df).first()["chi2"], expected, rel_tol=1e-9)
    assert crosstab(df, "u", "v").count() == 9


def test_kolmogorov_series(spark):
    row = spark.range(1).select(
        kolmogorov_pvalue(F.lit(0.0), F.lit(10), F.lit(10)).alias("none"),
        kolmogorov_pvalue(F.lit(1.0), F.lit(100), F.lit(100)).alias("all"),
        kolmogorov_pvalue(F.lit(1.3581 / math.sqrt(50)), F.lit(100), F.lit(100)).alias("five"),
    ).first()
    assert row["none"] == 1.0 and row["all"] < 1e-12 and abs(row["five"] - 0.05) < 1e-4


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b"), (3, None)], "n int, s string")
    assert duplicate_count(df).first()[0] == 2
    assert duplicate_count(df.where("false")).first()[0] == 0
    summary = {(r["column"], r["metric"]): r["value"] for r in data_summary(df).collect()}
    assert summary[None, "rows"] == "5" and summary["n", "nulls"] == "2" and summary["s", "class"] == "categorical"
    top = categorical_topk(df).orderBy("rank").collect()
    assert [(r["value"], r["count"], r["distinct_values"]) for r in top] == [("a", 2, 2), ("b", 2, 2)]
    one = describe_numeric(spark.createDataFrame([(7.0,)], "x double")).first()
    assert one["std"] is None and one["p25"] == 7.0
    flat = numeric_ranges(spark.createDataFrame([(1.0, 2.0), (1.0, 5.0)], "a double, b double")).collect()
    assert {r["ratio"] for r in flat} == {None}
    with pytest.raises(ValueError):
        preview(df, 0)
    const = correlation_matrix(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"))
    assert const.where("x = 'a'").where("correlation IS NOT NULL").count() == 0


def test_splits_are_exact_disjoint_and_repeatable(spark):
    df = spark.range(1003).withColumn("c", F.when(F.col("id") < 3, "tiny").otherwise("big"))
    flagged = holdout(df, ["id"], 0.2, "c")
    sizes = {r["c"]: r["t"] for r in flagged.groupBy("c").agg(F.sum("is_test").alias("t")).collect()}
    assert sizes == {"tiny": 1, "big": 200}
    assert sorted(flagged.collect()) == sorted(holdout(df.repartition(7), ["id"], 0.2, "c").collect())
    narrow = holdout(df, ["id"], 0.2, "c", small=20, ranges=5)
    assert sorted(flagged.collect()) == sorted(narrow.collect())
    folds = [r["count"] for r in fold_column(df, ["id"], 5).groupBy("fold").count().orderBy("fold").collect()]
    assert folds == [201, 201, 201, 200, 200]
    parts = {r["part"]: r["count"] for r in three_way(df, ["id"]).groupBy("part").count().collect()}
    assert parts == {"test": 201, "validation": 201, "train": 601}
    with pytest.raises(ValueError):
        fold_column(df, ["id"], 1)
    assert time_split(spark.range(10).selectExpr("id", "timestamp_seconds(id) AS ts"), "ts").where("is_test = 1").count() == 2


def test_curves(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y int, s double")
    assert math.isclose(roc_auc(df, "y", "s").first()[0], 0.875)
    for options in ({}, {"small": 0, "ranges": 3}):
        roc = [(r["fpr"], r["tpr"]) for r in roc_curve(df, "y", "s", **options).orderBy(F.desc("threshold")).collect()]
        assert roc == [(0.0, 0.0), (0.0, 0.5), (0.5, 1.0), (1.0, 1.0)]
    pr = pr_curve(df, "y", "s").orderBy(F.desc_nulls_last("threshold")).collect()
    assert (pr[0]["precision"], pr[-1]["precision"], pr[-1]["recall"]) == (1.0, 1.0, 0.0)
    with pytest.raises(ValueError):
        roc_curve(df.where("y = 1"), "y", "s")
    assert roc_auc(df.where("y = 1"), "y", "s").first()[0] is None


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    row = classification_metrics(df, "y", "p").first()
    assert row["accuracy"] == 0.5 and math.isclose(row["precision"], 0.5 + 0.25 / 3)
    two = spark.createDataFrame([(1, 1), (1, 0), (0, 0)], "y int, p int")
    assert averaged_metrics(two, "y", "p").first()["recall"] == 0.5
    perfect = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "y double, p double")
    assert regression_metrics(perfect, "y", "p").first()["r2_score"] == 1.0
    points = spark.createDataFrame([([0.0, 0.0], 0), ([0.0, 1.0], 0), ([9.0, 9.0], 1), ([9.0, 8.0], 1)], "v array<double>, l int")
    assert silhouette(points, "v", "l") > 0.9
    odd = points.unionByName(spark.createDataFrame([([50.0, 0.0], 7), (None, 1), ([1.0, 1.0], None)], points.schema))
    rows = {r["label"]: (r["n"], r["silhouette"]) for r in silhouette_by_label(odd, "v", "l").collect()}
    assert rows[7] == (1, 0.0) and rows[0][0] == rows[1][0] == 2 and min(rows[0][1], rows[1][1]) > 0.9
    lone = clustering_metrics(points.where("l = 0"), "v", "l").first()
    assert lone["clusters"] == 1 and lone["silhouette"] is None and lone["davies_bouldin"] is None


def test_plot_tables(spark):
    df = spark.createDataFrame([(float(i), "g" if i % 2 else "h") for i in range(101)], "x double, g string")
    bins = histogram(df, "x", 10).orderBy("bin").collect()
    assert [b["count"] for b in bins] == [10] * 9 + [11]
    assert histogram(spark.createDataFrame([(4.0,), (4.0,)], "x double"), "x", 3).agg(F.sum("count")).first()[0] == 2
    curve = density(df, "x", points=64).orderBy("point").collect()
    width = curve[1]["grid"] - curve[0]["grid"]
    assert 0.8 < sum(c["density"] for c in curve) * width < 1.0
    assert {r["x"]: r["median"] for r in box(df, "g", "x").collect()} == {"g": 50.0, "h": 50.0}
    tables, errors = plot_batch(df, [{"plot": "histogram", "x": "nope"}, {"plot": "countplot", "x": "g"}, {"plot": "bar"}])
    assert set(tables) == {1} and set(errors) == {0, 2}


def test_principal_components_match_covariance(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3)) @ np.array([[2.0, 0.3, 0.0], [0.0, 1.0, 0.2], [0.0, 0.0, 0.5]]) + [10, -4, 3]
    df = spark.createDataFrame([tuple(map(float, r)) + ("c",) for r in x], "a double, b double, c double, k string")
    out = principal_components(df, "k")
    values, vectors = np.linalg.eigh(np.cov(x.T))
    first = out.first()
    assert math.isclose(first["explained_1"], values[-1] / values.sum(), rel_tol=1e-9)
    scores = np.array([[r["PC1"], r["PC2"]] for r in out.collect()])
    assert abs(scores.mean(axis=0)).max() < 1e-9
    assert math.isclose(scores[:, 0].var(ddof=1), values[-1], rel_tol=1e-9)
    with pytest.raises(ValueError):
        principal_components(df.select("a"))


def test_selection(spark):
    df = spark.range(400).select(
        (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 + F.col("id") % 7 / 100).alias("good"),
        (F.col("id") % 11).cast("double").alias("noise"), F.lit(1.0).alias("flat"),
    )
    for method in ("f_score", "mutual_info", "chi2"):
        assert select_features(df, "y", method, 1) == ["good"]
    assert mutual_information(df, ["good", "flat"], "y").where("feature = 'flat'").first()["score"] == 0.0
    with pytest.raises(ValueError):
        chi2(df.withColumn("neg", F.lit(-1.0)), ["neg"], "y")
    with pytest.raises(ValueError):
        feature_scores(df, "y", "magic")
    assert detect_task(df, "noise") == "classification" and detect_task(spark.range(50), "id") == "regression"


def test_drift_and_fairness(spark):
    a = spark.range(1000).select((F.col("id") % 100).alias("x"), F.lit(1.0).alias("same"))
    b = spark.range(500).select((F.col("id") % 100 + 40).alias("x"), F.lit(1.0).alias("same"))
    found = {r["column"]: r for r in drift_ks(a, b).collect()}
    spread = {r["column"]: r for r in drift_ks(a, b, small=0, ranges=4).collect()}
    assert found == spread
    assert found["x"]["drift"] and math.isclose(found["x"]["ks_statistic"], 0.4)
    assert not found["same"]["drift"] and found["same"]["p_value"] == 1.0
    df = spark.createDataFrame([("u", 1, 1), ("u", 0, 0), ("v", 1, 0), ("v", 0, 0)], "g string, y int, p int")
    out = fairness(df, ["g"], "y", "p").collect()
    assert {r["group"]: r["score"] for r in out} == {"u": 1.0, "v": 0.5} and all(r["potential_bias"] for r in out)


def test_binned_density_stays_within_its_bound(spark):
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.normal(size=2000), rng.exponential(size=500) * 5, [1e6]])  # an outlier stretches the grid
    df = spark.createDataFrame([(float(v), "ab"[i % 2]) for i, v in enumerate(values[:-1])] + [(1e6, None), (None, "a")], "v double, g string")
    for source in (df, df.where("v < 1000")):
        h = source.agg(F.stddev_samp("v") * F.pow(F.count("v"), F.lit(-0.2))).first()[0]
        binned, exact = ({r["point"]: r["density"] for r in density(source, "v", points=200, exact=e).collect()} for e in (False, True))
        assert len(binned) == 200 and max(abs(binned[p] - exact[p]) for p in exact) <= 0.0002 / h
    both = [{(r["x"], r["point"]): r["density"] for r in density(df, "v", "g", 50, e).collect()} for e in (False, True)]
    assert both[0].keys() == both[1].keys() and len(both[0]) == 100 and max(abs(both[0][k] - both[1][k]) for k in both[0]) < 0.001


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).alias("x"), F.rand(3).alias("y"), F.lit("c").alias("color"))
    df = spark.createDataFrame(df.collect(), df.schema)
    samples = [sorted(scatter(df.repartition(n), "id", "x", None, 100, ["id"]).collect()) for n in (1, 64)]
    assert samples[0] == samples[1] and len(samples[0]) == 100
    doubled = df.unionByName(df)
    assert scatter(doubled, "x", "y", None, 50).count() == 50 and scatter(df, "x", "y").count() == 3000
    points = pair_points(df, color="color", max_rows=10, keys=["id"])
    assert points.columns == ["x_column", "y_column", "x", "y", "color"] and points.count() == 10
    assert pair_points(df.select("x"), keys=[]).count() == 0
