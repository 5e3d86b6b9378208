import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.models import forest, training
from tabulon.models.forest import Forest, Tree, ForestSettings, bins_of, grown, poisson
from tabulon.models.training import feature_importance, fit_model, load_model

FEW = {"n_estimators": 8}


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(3000).select(
        "id", ((F.col("id") * 7) % 50).cast("double").alias("a"), ((F.col("id") * 3) % 11).cast("double").alias("b"), ((F.col("id") * 13) % 97).cast("double").alias("c"),
    )
    noise = F.pmod(F.xxhash64("id"), F.lit(100)) / 100
    return df.withColumns({"y": F.col("a") * 2 + F.when(F.col("b") > 5, 30).otherwise(0) + noise, "k": ((F.col("a") > 25) | (F.col("b") > 8)).cast("int")}).persist()


@pytest.mark.parametrize(("target", "kind"), [("y", "random_forest_regressor"), ("k", "random_forest_classifier")])
def test_fit_does_not_depend_on_partitions(spark, rows, target, kind, tmp_path):
    one, other = (fit_model(rows.repartition(n, *by), target, kind, FEW, list("abc")) for n, by in ((3, ["a"]), (17, ["id"])))
    assert isinstance(one.stages.stages[-1], Forest)
    scores = [{r.id: r.prediction for r in m.transform(rows).collect()} for m in (one, other)]
    assert len(scores[0]) == 3000 and all(scores[0][i] == pytest.approx(scores[1][i]) for i in scores[0])
    assert [r.importance for r in feature_importance(one, spark).collect()] == pytest.approx([r.importance for r in feature_importance(other, spark).collect()])
    one.save(str(tmp_path / "m"))
    again = {r.id: r.prediction for r in load_model(spark, str(tmp_path / "m")).transform(rows).collect()}
    assert again == scores[0]
    missing = rows.withColumn("a", F.when(F.col("id") != 5, F.col("a")))
    assert [r.prediction is None for r in one.transform(missing.where("id < 7")).orderBy("id").collect()] == [False] * 5 + [True, False]


def test_agrees_with_sparks_forest(spark, rows, monkeypatch):
    ours = fit_model(rows, "y", "random_forest_regressor", {"n_estimators": 30}, list("abc"))
    own = fit_model(rows, "k", "random_forest_classifier", {"n_estimators": 30}, list("abc"))
    monkeypatch.setattr(forest, "CELLS", 10)  # too many cells: Spark's own
    plain = fit_model(rows, "y", "random_forest_regressor", {"n_estimators": 30}, list("abc"))
    assert not isinstance(plain.stages.stages[-1], Forest)
    gap = ours.transform(rows).select("id", "y", F.col("prediction").alias("p")).join(plain.transform(rows).select("id", "prediction"), "id")
    ours_error, plain_error = gap.agg(F.avg(F.abs(F.col("p") - F.col("y"))), F.avg(F.abs(F.col("prediction") - F.col("y")))).first()
    assert ours_error < 1.25 * plain_error + 0.05
    assert [r.importance for r in feature_importance(ours, spark).collect()] == pytest.approx([r.importance for r in feature_importance(plain, spark).collect()], abs=0.05)
    scored = own.transform(rows)
    assert scored.where("k = prediction").count() > 2950
    assert scored.where(F.abs(F.aggregate("probability", F.lit(0.0), lambda x, y: x + y) - 1) > 1e-9).count() == 0


def test_rows_that_are_drawn_together_follow_poisson():
    u = np.random.default_rng(1).random((3, 200_000))
    for n, drawn in zip((1, 60, 1_000_000), poisson(np.array([1, 60, 1_000_000]), u)):
        assert drawn.mean() == pytest.approx(n, abs=5 * np.sqrt(n / 200_000)) and drawn.var() == pytest.approx(n, rel=0.03)


def test_tree_of_plain_cells():
    edges = [[0.5, 1.5], [0.5]]
    cells = np.arange(6)
    x = bins_of(cells, edges)
    assert x.tolist() == [[0, 0], [0, 1], [1, 0], [1, 1], [2, 0], [2, 1]]
    y = np.array([1.0, 1.0, 2.0, 5.0, 2.0, 5.0])
    sums = np.column_stack([np.full(6, 2.0), 2 * y, 2 * y * y])
    for least, leaves in ((1, 3), (7, 1)):
        tree, importance = grown(cells, sums, edges, ForestSettings(1, 30, least, 2, 1), False, 0.0, np.random.default_rng(1))
        tree = Tree.unpack(tree.pack(), 1)
        assert len(set(tree.leaves(x))) == leaves
        if least == 1:
            assert tree.value[tree.leaves(x)][:, 0] == pytest.approx(y) and importance.sum() == pytest.approx(1)


def test_one_row_and_constant_labels(spark):
    one = spark.createDataFrame([(1.0, 2.0, 0)], "a double, y double, k int")
    assert fit_model(one, "y", "random_forest_regressor", {"n_estimators": 3}, ["a"]).transform(one).first().prediction in (2.0, 0.0, None)
    flat = spark.range(50).select(F.col("id").cast("double").alias("a"), F.lit(3.0).alias("y"))
    model = training.fit_model(flat, "y", "random_forest_regressor", FEW, ["a"])
    assert {r.prediction for r in model.transform(flat).collect()} == {3.0}
