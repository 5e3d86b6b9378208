"""The six offline stages in one session: prepare, engineer, train, evaluate, validate, package."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import col, require
from ..models.catalogue import family_model
from ..models.training import FittedModel, feature_importance, fit_model, load_model
from ..operators.detect import detect_task
from ..operators.split import holdout
from ..operators.validate import drift_ks, explainability_check, threshold_check, validation_report
from ..session import freeze
from .preprocess import Features, fit_features, prepare_data
from .training import evaluate


class Package:
    """Feature stages and model saved together; scores raw records."""

    def __init__(self, features: PipelineModel, model: FittedModel):
        self.features, self.model = features, model

    def score(self, raw: DataFrame) -> DataFrame:
        """Encode, scale, select and predict; an unseen category gets the encoder's fallback value."""
        return self.model.transform(self.features.transform(raw))

    def save(self, path: str) -> None:
        self.features.write().overwrite().save(f"{path}/features")
        self.model.save(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Package:
        return Package(PipelineModel.load(f"{path}/features"), load_model(spark, f"{path}/model"))


def package(fitted: Features, model: FittedModel, input_columns: Sequence[str], spark: SparkSession) -> Package:
    return Package(fitted.stages(input_columns, spark), model)


def end_to_end(
    df: DataFrame,
    target: str,
    keys: Sequence[str],
    path: str,
    family: str = "random_forest",
    params: dict | None = None,
    test_size: float = 0.2,
    performance_threshold: float = 0.85,
    feature_options: dict | None = None,
) -> dict:
    """Run all stages; returns the tables of each and leaves the package under ``path``.

    Keys travel beside the features. Statistics are fitted on the training rows only.
    """
    require(df, target, *keys)
    spark = df.sparkSession
    names = [c for c in df.columns if c not in keys]
    # neither keys nor the target are imputed or treated as outliers: a rare class is not an outlier
    prepared = freeze(prepare_data(df, keys=[*keys, target]), "prepared")
    task = detect_task(prepared, target)
    stratify = target if task == "classification" else None
    parts = freeze(holdout(prepared, keys, test_size, stratify, name="__test"), "parts")
    train = parts.where("__test = 0").select(*[col(c) for c in names])
    test = parts.where("__test = 1").select(*[col(c) for c in names])

    fitted = fit_features(train, target, **(feature_options or {}))
    model_type, settings = family_model(family, task, params)
    engineered = freeze(fitted.fitting, "engineered")
    model = fit_model(engineered, target, model_type, settings, fitted.selected)
    bundle = package(fitted, model, names, spark)
    bundle.save(path)

    scored = bundle.score(test)
    metrics = evaluate(scored, model)
    table = spark.createDataFrame([tuple(float(v) for v in metrics.values())], ", ".join(f"{k} double" for k in metrics))
    shared = [c for c in fitted.originals if c not in keys]
    drift = drift_ks(train.select(*[col(c) for c in shared]), test.select(*[col(c) for c in shared]), threshold=0.05)
    report = validation_report(
        scored, target, "prediction", drift, performance_threshold, task == "classification"
    )
    out = {
        "prepared": prepared, "engineered": engineered, "task": task, "metrics": table,
        "thresholds": threshold_check(table), "drift": drift, "report": report, "path": path,
    }
    if family != "neural_network":
        out["explainability"] = explainability_check(feature_importance(model, spark))
    return out
