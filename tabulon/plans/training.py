"""Train, cross-validate, tune and score."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import col, require
from ..models.catalogue import hyperparameters, is_classifier
from ..models.training import FittedModel, feature_columns, fit_model
from ..operators.metrics import classification_metrics, regression_metrics, roc_auc
from ..operators.split import fold_column, holdout

PARALLEL_FITS = 4


def evaluate(scored: DataFrame, model: FittedModel) -> dict[str, float]:
    """The metrics of a scored table; ROC AUC too for binary models that give probabilities."""
    if not model.classification:
        row = regression_metrics(scored, model.target, "prediction").first()
        return {k: row[k] for k in ("mae", "mse", "rmse", "r2_score")}
    row = classification_metrics(scored, model.target, "prediction").first()
    out = {k: row[k] for k in ("accuracy", "precision", "recall", "f1_score")}
    if len(model.classes) == 2 and "probability" in scored.columns:
        binary = scored.select(
            (col(model.target) == F.lit(model.classes[1])).cast("int").alias("y"), F.get("probability", F.lit(1)).alias("s")
        )
        auc = roc_auc(binary, "y", "s").first()[0]
        if auc is not None:
            out["roc_auc"] = auc
    return out


def train_model(
    df: DataFrame,
    target: str,
    model_type: str,
    keys: Sequence[str],
    test_size: float = 0.2,
    params: dict | None = None,
    features: Sequence[str] | None = None,
    cv_folds: int | None = None,
    seed: int = 42,
) -> FittedModel:
    """Fit on the training part of a repeatable split; ``info`` holds train/test metrics and CV scores.

    ``keys`` identify a row and are not features. Classification splits are stratified.
    """
    require(df, target, *keys)
    features = feature_columns(df, target, keys) if features is None else list(features)
    classification = is_classifier(model_type)
    parts = holdout(df, keys, test_size, target if classification else None, seed, name="__test").persist()
    key = keys[0] if len(keys) == 1 else None
    try:
        train, test = parts.where("__test = 0"), parts.where("__test = 1")
        model = fit_model(train, target, model_type, params, features, key)
        info: dict = {
            "model_type": model_type, "hyperparameters": _plain(model.params), "is_classifier": classification,
            "n_features": len(features), "test_size": test_size,
        }
        for name, part in (("train", train), ("test", test)):
            scored = model.transform(part, key)
            info.update({f"{name}_{k}": v for k, v in evaluate(scored, model).items()})
    finally:
        parts.unpersist()
    if cv_folds is not None:
        scores = cross_val_score(df, target, model_type, keys, cv_folds, params, features, seed=seed)
        info.update(
            cv_scores=scores, cv_mean=float(np.mean(scores)), cv_std=float(np.std(scores)),
            cv_scoring="accuracy" if classification else "r2",
        )
    model.info = info
    return model


def _plain(params: dict) -> dict:
    return {k: list(v) if isinstance(v, tuple) else v for k, v in params.items()}


def _score(scored: DataFrame, model: FittedModel, scoring: str) -> float:
    """The score over the rows that have a prediction."""
    scored = scored.where(F.col("prediction").isNotNull())
    if scoring == "accuracy":
        return scored.agg(F.avg((col(model.target) == F.col("prediction")).cast("double"))).first()[0]
    if scoring in ("precision", "recall", "f1_score"):
        return classification_metrics(scored, model.target, "prediction").first()[scoring]
    row = regression_metrics(scored, model.target, "prediction").first()
    return {"r2": row["r2_score"], "neg_mean_squared_error": -row["mse"], "neg_mean_absolute_error": -row["mae"]}[scoring]


def _check_scoring(model_type: str, scoring: str | None) -> str:
    allowed = (
        ("accuracy", "precision", "recall", "f1_score") if is_classifier(model_type)
        else ("r2", "neg_mean_squared_error", "neg_mean_absolute_error")
    )
    scoring = scoring or allowed[0]
    if scoring not in allowed:
        raise ValueError(f"scoring must be one of {', '.join(allowed)}")
    return scoring


def fold_scores(
    folded: DataFrame, fold: str, folds: int, target: str, model_type: str, params_list: Sequence[dict],
    features: Sequence[str], scoring: str, key: str | None, parallel: int = PARALLEL_FITS,
) -> list[list[float]]:
    """Scores per candidate and fold; several fits run at a time as concurrent Spark jobs."""
    def one(task: tuple[int, int]) -> float:
        candidate, held = task
        model = fit_model(
            folded.where(col(fold) != held), target, model_type, params_list[candidate], features, key
        )
        return _score(model.transform(folded.where(col(fold) == held), key), model, scoring)

    tasks = list(product(range(len(params_list)), range(folds)))
    with ThreadPool(min(parallel, len(tasks))) as pool:
        flat = pool.map(one, tasks)
    return [flat[i * folds:(i + 1) * folds] for i in range(len(params_list))]


def cross_val_score(
    df: DataFrame,
    target: str,
    model_type: str,
    keys: Sequence[str],
    folds: int = 5,
    params: dict | None = None,
    features: Sequence[str] | None = None,
    scoring: str | None = None,
    seed: int = 42,
    parallel: int = PARALLEL_FITS,
) -> list[float]:
    """Score of each fold; folds are stratified for classifiers."""
    scoring = _check_scoring(model_type, scoring)
    features = feature_columns(df, target, keys) if features is None else list(features)
    stratify = target if is_classifier(model_type) else None
    folded = fold_column(df, keys, folds, stratify, seed, name="__fold").persist()
    key = keys[0] if len(keys) == 1 else None
    try:
        return fold_scores(
            folded, "__fold", folds, target, model_type, [params or {}], features, scoring, key, parallel
        )[0]
    finally:
        folded.unpersist()


def expand_grid(grid: dict[str, Sequence]) -> list[dict]:
    names = sorted(grid)
    return [dict(zip(names, values)) for values in product(*(grid[n] for n in names))]


def grid_search(
    df: DataFrame,
    target: str,
    model_type: str,
    keys: Sequence[str],
    grid: dict[str, Sequence],
    folds: int = 5,
    scoring: str | None = None,
    features: Sequence[str] | None = None,
    seed: int = 42,
    parallel: int = PARALLEL_FITS,
) -> tuple[FittedModel, list[dict]]:
    """The model refitted on all rows with the best candidate, and every candidate's mean and std."""
    scoring = _check_scoring(model_type, scoring)
    candidates = expand_grid(grid)
    for c in candidates:
        hyperparameters(model_type, c)
    features = feature_columns(df, target, keys) if features is None else list(features)
    stratify = target if is_classifier(model_type) else None
    folded = fold_column(df, keys, folds, stratify, seed, name="__fold").persist()
    key = keys[0] if len(keys) == 1 else None
    try:
        scores = fold_scores(
            folded, "__fold", folds, target, model_type, candidates, features, scoring, key, parallel
        )
        results = [
            {"params": c, "mean_score": float(np.mean(s)), "std_score": float(np.std(s))}
            for c, s in zip(candidates, scores)
        ]
        best = max(range(len(results)), key=lambda i: results[i]["mean_score"])
        model = fit_model(folded, target, model_type, candidates[best], features, key)
    finally:
        folded.unpersist()
    model.info = {
        "best_params": _plain(candidates[best]), "best_score": results[best]["mean_score"], "scoring": scoring,
        "cv_folds": folds, "model_type": model_type,
    }
    return model, results


def predict(model: FittedModel | None, df: DataFrame, key: str | None = None) -> DataFrame:
    """Score any table with the model's feature columns: one record or many."""
    if model is None:
        raise ValueError("no trained model available")
    return model.transform(df, key)


def metric_rows(spark: SparkSession, info: dict) -> DataFrame:
    """(metric, value) rows from a model's numeric info entries."""
    rows = [(k, float(v)) for k, v in info.items() if isinstance(v, (int, float)) and not isinstance(v, bool)]
    return spark.createDataFrame(rows, "metric string, value double")
