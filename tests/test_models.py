"""Models: closed forms, reloads, tuning, scoring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.models.catalogue import DEFAULTS, available_models, family_model, hyperparameters, is_classifier
from tabulon.models.training import feature_importance, fit_model, load_model, top_importance
from tabulon.operators.validate import explainability_check
from tabulon.plans.chain import Package, end_to_end, package
from tabulon.plans.learning_curve import learning_curve
from tabulon.plans.preprocess import apply_preprocessing, engineer_features, export_processed, fit_features, recommend
from tabulon.plans.training import cross_val_score, expand_grid, grid_search, predict, train_model


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 0.1 * rng.normal(size=300) + 5
    rows = [
        (i, *map(float, r), float(t), int(t > 5), "abc"[int(i % 3)])
        for i, (r, t) in enumerate(zip(x, y))
    ]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, k int, s string").persist()


FEATURES = ["a", "b", "c"]


def matrix(table):
    rows = table.orderBy("id").collect()
    return np.array([[r[c] for c in FEATURES] for r in rows]), np.array([r["y"] for r in rows])


def test_catalogue():
    models = available_models()
    assert len(models["classification"]) == 10 and len(models["regression"]) == 11
    assert len(DEFAULTS) == 21
    assert hyperparameters("ridge", {"alpha": 2})["alpha"] == 2
    assert family_model("neural_network", "regression")[0] == "mlp_regressor"
    for bad in (lambda: is_classifier("magic"), lambda: hyperparameters("ridge", {"beta": 1}), lambda: family_model("x", "y")):
        with pytest.raises(ValueError):
            bad()


def predictions(model, table, key=None):
    return np.array([r["prediction"] for r in model.transform(table, key).orderBy("id").collect()])


def test_linear_closed_forms(table):
    x, y = matrix(table)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    for kind, alpha in (("linear_regression", 0.0), ("ridge", 7.0)):
        params = {"alpha": alpha} if alpha else None
        model = fit_model(table, "y", kind, params, FEATURES)
        w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
        np.testing.assert_allclose(predictions(model, table), xc @ w + y.mean(), rtol=1e-6)
    strong = fit_model(table, "y", "lasso", {"alpha": 100.0}, FEATURES)
    np.testing.assert_allclose(predictions(strong, table), y.mean(), rtol=1e-6)


@pytest.mark.parametrize("kind", [m for m in available_models()["classification"] if m != "knn_classifier"])
def test_classifiers_learn_and_reload(spark, table, tmp_path, kind):
    small = {"n_estimators": 5} if "n_estimators" in DEFAULTS[kind] else {}
    small |= {"n_components": 40, "max_iter": 15} if kind == "svc" else {}
    model = fit_model(table, "k", kind, small, FEATURES)
    scored = model.transform(table)
    assert scored.where("prediction = k").count() > 255
    model.save(str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    assert sorted(again.transform(table).select("id", "prediction").collect()) == sorted(scored.select("id", "prediction").collect())
    if "probability" in scored.columns:
        assert scored.where(F.abs(F.aggregate("probability", F.lit(0.0), lambda a, b: a + b) - 1) > 1e-9).count() == 0


@pytest.mark.parametrize("kind", [m for m in available_models()["regression"] if m not in ("knn_regressor", "linear_regression", "ridge")])
def test_regressors_learn(table, kind):
    small = {"n_estimators": 20} if "n_estimators" in DEFAULTS[kind] else {}
    small |= {"alpha": 0.01} if kind in ("lasso", "elastic_net") else {}
    small |= {"hidden_layer_sizes": (8, 4), "max_iter": 40, "solver": "lbfgs"} if kind == "mlp_regressor" else {}
    small |= {"C": 50.0, "max_iter": 30} if kind == "svr" else {}
    model = fit_model(table, "y", kind, small, FEATURES)
    y = matrix(table)[1]
    error = predictions(model, table) - y
    assert 1 - (error**2).mean() / y.var() > 0.8


def test_three_classes(table):
    df = table.withColumn("m", F.when(F.col("y") > 7, "high").when(F.col("y") > 3, "mid").otherwise("low"))
    quick = {"gradient_boosting_classifier": {"n_estimators": 3}, "svc": {"n_components": 30, "max_iter": 10}}
    for kind in ("svc", "gradient_boosting_classifier", "naive_bayes", "logistic_regression"):
        small = quick.get(kind)
        scored = fit_model(df, "m", kind, small, FEATURES).transform(df)
        assert {r[0] for r in scored.select("prediction").distinct().collect()} <= {"high", "mid", "low"}
        assert scored.where("prediction = m").count() > 200


def test_neighbours(spark, table, tmp_path):
    x, y = matrix(table)
    model = fit_model(table, "y", "knn_regressor", {"n_neighbors": 3}, FEATURES, "id")
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    expected = y[np.argsort(d, axis=1, kind="stable")[:, :3]].mean(axis=1)
    np.testing.assert_allclose(predictions(model, table, "id"), expected, rtol=1e-9)
    model.save(str(tmp_path / "m"))
    np.testing.assert_allclose(predictions(load_model(spark, str(tmp_path / "m")), table, "id"), expected, rtol=1e-9)
    votes = fit_model(table, "k", "knn_classifier", None, FEATURES).transform(table, "id")
    assert votes.where("prediction = k").count() > 270
    with pytest.raises(ValueError):
        model.transform(table)


def test_training_checks(table):
    with pytest.raises(ValueError):
        fit_model(table, "k", "logistic_regression")  # text column s
    with pytest.raises(ValueError):
        fit_model(table, "nope", "ridge", None, FEATURES)
    with pytest.raises(ValueError):
        fit_model(table.where("k = 1"), "k", "naive_bayes", None, FEATURES)
    with pytest.raises(ValueError):
        predict(None, table)


def test_train_and_tune(table):
    model = train_model(table.drop("y", "s"), "k", "logistic_regression", ["id"], cv_folds=3)
    assert model.features == FEATURES and len(model.info["cv_scores"]) == 3
    assert model.info["test_accuracy"] > 0.9 and model.info["test_roc_auc"] > 0.95
    with pytest.raises(ValueError):
        cross_val_score(table, "k", "logistic_regression", ["id"], 1, features=FEATURES)
    with pytest.raises(ValueError):
        cross_val_score(table, "k", "logistic_regression", ["id"], 3, features=FEATURES, scoring="r2")
    assert len(expand_grid({"a": [1, 2], "b": [3, 4, 5]})) == 6
    best, results = grid_search(table, "y", "ridge", ["id"], {"alpha": [0.1, 10000.0]}, 3, features=FEATURES)
    assert best.info["best_params"] == {"alpha": 0.1} and results[0]["mean_score"] > results[1]["mean_score"]


def test_importance(spark, table):
    model = fit_model(table, "y", "random_forest_regressor", {"n_estimators": 5, "max_depth": 5}, FEATURES)
    rows = feature_importance(model, spark)
    assert [r["feature"] for r in top_importance(rows, 2).collect()] == ["a", "b"]
    assert explainability_check(rows).first()["dominant_feature"] == "a"
    with pytest.raises(ValueError):
        feature_importance(fit_model(table, "k", "naive_bayes", None, FEATURES), spark)


def test_learning_curve(table):
    curve = learning_curve(
        table.select("id", *FEATURES, "k"), "k", "decision_tree_classifier", ["id"], {"max_depth": 3}, (0.3, 1.0), 2
    ).orderBy("share").collect()
    assert [r["share"] for r in curve] == [0.3, 1.0] and curve[1]["validation_mean"] > 0.7


def test_step_lists(spark, table, tmp_path):
    df = table.select("id", "a", "s")
    outcome = apply_preprocessing(df, {"normalization": "a", "encoding": "s", "imputation": "missing", "turn": "a"})
    assert outcome.applied == ["normalization on a", "encoding on s"] and len(outcome.errors) == 2
    assert outcome.columns_after == ["id", "a", "s_b", "s_c"]
    assert {r["state"]: r["n_columns"] for r in outcome.shapes(df).collect()} == {"before": 3, "after": 4}
    with pytest.raises(ValueError):
        export_processed(df, {"turn": "a"}, str(tmp_path / "x"), "csv")
    methods = {(r["operation"], r["column"]): r["method"] for r in recommend(
        df.withColumn("a", F.when(F.col("id") % 10 > 0, F.col("a")))
    ).collect()}
    assert methods["imputation", "a"] == "knn" and methods["encoding", "s"] == "one-hot"
    assert methods["normalization", "id"] == "standard"


def test_packaged_chain(spark, table, tmp_path):
    raw = table.select("a", "b", "s", "y")
    fitted = fit_features(raw, "y", selection="f_score", max_features=4)
    engineered, _ = engineer_features(raw, "y", selection="f_score", max_features=4)
    assert engineered.columns[-1] == "y" and len(engineered.columns) == 5
    model = fit_model(engineered, "y", "ridge", None, fitted.selected)
    bundle = package(fitted, model, raw.columns, spark)
    bundle.save(str(tmp_path / "p"))
    before = sorted(r["prediction"] for r in bundle.score(raw).collect())
    after = sorted(r["prediction"] for r in Package.load(spark, str(tmp_path / "p")).score(raw).collect())
    np.testing.assert_allclose(before, after)
    unseen = raw.limit(5).withColumn("s", F.lit("zz"))
    assert bundle.score(unseen).where("prediction IS NULL").count() == 0


def test_end_to_end(table, tmp_path):
    out = end_to_end(
        table.select("id", "a", "b", "s", "y"), "y", ["id"], str(tmp_path / "e"), params={"n_estimators": 10}
    )
    assert out["task"] == "regression"
    assert out["metrics"].first()["r2_score"] > 0.7
    assert out["drift"].count() == 2 and out["report"].count() == 1


def test_rows_with_missing_features_stay(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("x"), (2.0 * F.col("id")).alias("y"))
    line = fit_model(rows, "y", "linear_regression", None, ["x"])
    scored = {r.id: r.prediction for r in line.transform(rows).collect()}
    assert len(scored) == 100 and all((p is None) == (i % 5 == 0) for i, p in scored.items())
    near = fit_model(rows, "y", "knn_regressor", {"n_neighbors": 1}, ["x"], "id").transform(rows, "id").collect()
    assert len(near) == 100 and sum(r.prediction is None for r in near) == 20


def test_many_classes(spark):
    rows = spark.range(450).select("id", (F.col("id") % 150).cast("string").alias("c"), (F.col("id") % 150).cast("double").alias("x"))
    assert fit_model(rows, "c", "naive_bayes", None, ["x"]).transform(rows).where("prediction = c").count() > 0


def test_tree_depth_beyond_the_limit_is_refused(spark):
    rows = spark.range(10).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    with pytest.raises(ValueError, match="max_depth"):
        fit_model(rows, "y", "decision_tree_regressor", {"max_depth": 31})
