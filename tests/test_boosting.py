"""Second-order boosting, networks and hyperparameters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.models.boosting import BINS, Booster, Settings, Tree, fit_boosted
from tabulon.models.catalogue import DEFAULTS, FAMILIES, family_model, hyperparameters
from tabulon.models.network import ACTIVATIONS, network_loss
from tabulon.models.training import feature_importance, fit_model, load_model

PLAIN = Settings(3, 0.3, None, 3, 1.0, 0.0, 1.0, 1, 1.0, 1.0, 7, 10)


@pytest.fixture(scope="module")
def table(spark):
    """Two informative features of few and of many values, a useless one, and gaps that mean something."""
    rng = np.random.default_rng(3)
    a, b, c = rng.integers(0, 12, 1500).astype(float), rng.normal(size=1500), rng.normal(size=1500)
    y = np.where(a > 5, 4.0, 0.0) + 2 * (b > 0.3) * (a < 9) + 0.3 * rng.normal(size=1500)
    gaps = rng.random(1500) < 0.2
    y = y + 3 * gaps
    rows = [(i, float(a[i]), None if gaps[i] else float(b[i]), float(c[i]), float(y[i]), "lmh"[int(y[i] > 2) + int(y[i] > 5)]) for i in range(1500)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, k string").repartition(4).persist()


def arrays(table):
    rows = table.orderBy("id").collect()
    x = np.array([[np.nan if r[c] is None else r[c] for c in "abc"] for r in rows])
    return x, np.array([r["y"] for r in rows])


def reference_trees(x, y, s):
    """The same boosting by sorting each feature of each node, squared error, by level."""
    margin, out = np.full(len(y), y.mean()), []
    for _ in range(s.rounds):
        g, nodes, values = margin - y, [(np.arange(len(y)), 0)], np.zeros(len(y))
        while nodes:
            rows, depth = nodes.pop()
            best, whole = (1e-9, None), g[rows].sum() ** 2 / (len(rows) + s.reg_lambda)
            for f in range(x.shape[1]) if depth < s.depth else ():
                v, gap = x[rows, f], np.isnan(x[rows, f])
                for t in [*np.unique(v[~gap])[1:], np.inf]:  # the last parts missing values from all others
                    for side in (True, False):
                        left = np.where(gap, side, v < t)
                        n = left.sum()
                        if 0 < n < len(rows):
                            gl = g[rows][left].sum()
                            gain = (gl**2 / (n + s.reg_lambda) + (g[rows].sum() - gl) ** 2 / (len(rows) - n + s.reg_lambda) - whole) / 2
                            if gain > best[0] + 1e-9:
                                best = gain, left
            if best[1] is None:
                values[rows] = -s.rate * g[rows].sum() / (len(rows) + s.reg_lambda)
            else:
                nodes += [(rows[best[1]], depth + 1), (rows[~best[1]], depth + 1)]
        margin = margin + values
    return margin


def test_trees_equal_those_of_sorting(table):
    small = table.where("id < 240")  # fewer values than bins: all thresholds are tried
    x, y = arrays(small)
    model = fit_model(small, "y", "xgboost_regressor", {"n_estimators": 3, "learning_rate": 0.3, "max_depth": 3}, list("abc"))
    found = [r.prediction for r in model.transform(small).orderBy("id").collect()]
    np.testing.assert_allclose(found, reference_trees(x, y, PLAIN), rtol=1e-9)


def booster_on(table, **changes):
    rows = table.select(*[F.col(c).alias(f"__f{i}") for i, c in enumerate("abc")], F.col("y").alias("label"), F.lit(False).alias("__check"))
    return Booster(rows, [f"__f{i}" for i in range(3)], Settings(**{**PLAIN.__dict__, **changes}), 0)


def test_best_first_trees_have_exactly_the_leaves_asked_for(table):
    booster = booster_on(table, leaves=31, depth=None, reg_lambda=0.0, least_rows=20)
    tree = booster.grow()[0]
    leaves = [n for n, f in enumerate(tree.feature) if f < 0]
    assert len(leaves) == 31

    def depths(node=0, at=0):
        return [at] if tree.feature[node] < 0 else depths(tree.left[node], at + 1) + depths(tree.right[node], at + 1)

    assert len(set(depths())) > 1 and tree.depth() > 5
    # the same tree, one split at a time: each split is the best among all leaves of the tree so far
    gains = greedy_gains(booster, 31)
    assert len(gains) == 30 and np.isclose(sum(gains), booster.gains.sum())


def greedy_gains(booster, leaves):
    """Gains of best-first growth without looking ahead, from sums of each node taken alone."""
    tree, gains, features = Tree(), [], np.arange(3)
    split = booster.best_split(booster.histograms([tree], [[0]], [features])[0][0], features)
    waiting = {0: split}
    while len(gains) < leaves - 1:
        node = max((n for n in waiting if waiting[n]), key=lambda n: waiting[n].gain)
        best = waiting.pop(node)
        gains.append(best.gain)
        children = tree.split(node, best.feature, best.cut, 0.0, best.missing_left)
        for child, cells in zip(children, booster.histograms([tree], [list(children)], [features])[0]):
            waiting[child] = booster.best_split(cells, features)
    return gains


def test_many_values_are_binned_by_exact_quantiles(table):
    edges = booster_on(table).edges
    x, _ = arrays(table)
    assert edges[0].tolist() == list(range(1, 12)) and len(edges[2]) <= BINS - 1
    v = np.sort(x[:, 2])
    assert set(edges[2]) <= set(v) and np.diff(np.searchsorted(v, edges[2])).max() <= len(v) // BINS + 2


@pytest.mark.parametrize("kind", ["xgboost", "lightgbm"])
def test_missing_features_and_several_classes(spark, table, tmp_path, kind):
    model = fit_model(table, "k", f"{kind}_classifier", {"n_estimators": 8}, list("abc"))
    scored = model.transform(table)
    assert scored.where("prediction = k").count() > 1350
    assert scored.where("prediction IS NULL").count() == 0 and scored.where("b IS NULL AND prediction = k").count() > 230
    assert scored.where(F.abs(F.aggregate("probability", F.lit(0.0), lambda a, b: a + b) - 1) > 1e-9).count() == 0
    model.save(str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m")).transform(table)
    assert sorted(again.select("id", "prediction").collect()) == sorted(scored.select("id", "prediction").collect())
    importance = {r.feature: r.importance for r in feature_importance(model, spark).collect()}
    if kind == "xgboost":  # by mean gain
        assert importance["c"] < importance["b"] < importance["a"] and np.isclose(sum(importance.values()), 1)
    else:  # by number of splits
        assert all(v == int(v) > 0 for v in importance.values()) and sum(importance.values()) <= 8 * 3 * 30


def test_checking_rows_stop_the_rounds(table):
    noisy = table.withColumn("z", F.rand(4)).withColumn("check", F.col("id") % 3 == 0)
    model = fit_model(noisy, "z", "xgboost_regressor", {"n_estimators": 60, "early_stopping": "check", "patience": 3}, list("abc"))
    assert model.info["rounds"] < 20


def test_shares_of_rows_and_features(table):
    x, y = arrays(table)
    model = fit_model(table, "y", "xgboost_regressor", {"n_estimators": 15, "subsample": 0.5, "colsample_bytree": 0.67, "learning_rate": 0.3}, list("abc"))
    found = np.array([r.prediction for r in model.transform(table).orderBy("id").collect()])
    assert 1 - ((found - y) ** 2).mean() / y.var() > 0.9


def test_rows_without_a_label_or_without_variety(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0), (None, None)], "x double, y double")
    model = fit_model(rows, "y", "lightgbm_regressor", None, ["x"])
    assert [r.prediction for r in model.transform(rows).collect()] == [3.0, 3.0, 3.0] and model.info["rounds"] == 0
    with pytest.raises(ValueError):
        fit_boosted(rows.limit(0).select(F.col("x").alias("__f0"), F.col("y").alias("label")), 1, 0, PLAIN)


@pytest.mark.parametrize("activation", sorted(ACTIVATIONS))
@pytest.mark.parametrize("classes", [0, 3])
def test_network_gradient_matches_finite_differences(activation, classes):
    rng = np.random.default_rng(0)
    shapes = [(4, 5), (5, 3), (3, classes or 1)]
    theta = rng.normal(size=sum(a * b + b for a, b in shapes))
    x, y = rng.normal(size=(20, 4)), rng.integers(0, 3, 20).astype(float)
    loss = network_loss(shapes, activation, classes)
    _, gradient = loss(theta, x, y)
    for i in rng.permutation(len(theta))[:25]:
        step = np.zeros(len(theta))
        step[i] = 1e-6
        slope = (loss(theta + step, x, y)[0] - loss(theta - step, x, y)[0]) / 2e-6
        assert abs(slope - gradient[i]) < 1e-4 * max(1, abs(slope))


def test_network_learns_and_stops_on_a_plateau(spark, table, tmp_path):
    whole = table.where("b IS NOT NULL")
    settings = {"hidden_layer_sizes": (16,), "early_stopping": True, "learning_rate_init": 0.02, "max_iter": 150, "batch_size": 64}
    model = fit_model(whole, "k", "mlp_classifier", settings, list("abc"))
    scored = model.transform(whole)
    assert scored.where("prediction = k").count() > 0.85 * whole.count() and model.info["epochs"] < 150
    model.save(str(tmp_path / "n"))
    again = load_model(spark, str(tmp_path / "n")).transform(whole)
    assert sorted(again.select("id", "prediction").collect()) == sorted(scored.select("id", "prediction").collect())
    flat = fit_model(whole.withColumn("z", F.lit(1.0)), "z", "mlp_regressor", {"hidden_layer_sizes": (4,), "learning_rate_init": 0.02}, list("abc"))
    assert flat.info["epochs"] < 100


def test_every_default_dictionary_is_accepted():
    for kind, settings in DEFAULTS.items():
        assert {**hyperparameters(kind, settings), **settings} == hyperparameters(kind)
    for family, settings in FAMILIES.items():
        for task in ("classification", "regression"):
            kind, translated = family_model(family, task, settings)
            hyperparameters(kind, translated)
    assert family_model("neural_network", "regression", {"epochs": 5})[1]["max_iter"] == 5
    for kind, bad in (("svc", {"kernel": "poly"}), ("mlp_classifier", {"solver": "saga"}), ("logistic_regression", {"solver": "adam"}),
                      ("knn_classifier", {"weights": "odd"}), ("mlp_regressor", {"learning_rate": "adaptive"}), ("ridge", {"beta": 1})):
        with pytest.raises(ValueError, match=next(iter(bad))):
            hyperparameters(kind, bad)


def test_settings_change_the_models(table):
    whole = table.where("b IS NOT NULL").select("id", "a", "b", "y")

    def fitted(kind, **params):
        return [r.prediction for r in fit_model(whole, "y", kind, params, ["a", "b"], "id").transform(whole, "id").orderBy("id").collect()]

    x = np.array([[r.a, r.b] for r in whole.orderBy("id").collect()])
    y = np.array([r.y for r in whole.orderBy("id").collect()])
    np.testing.assert_allclose(fitted("linear_regression", fit_intercept=False), x @ np.linalg.lstsq(x, y, rcond=None)[0], rtol=1e-6)
    np.testing.assert_allclose(fitted("knn_regressor", weights="distance"), y, rtol=1e-9)  # each row is its own nearest neighbour
    assert fitted("decision_tree_regressor", min_samples_split=600) != fitted("decision_tree_regressor")
