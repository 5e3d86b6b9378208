"""Scores by training size."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col, numeric_columns, require
from ..models.catalogue import is_classifier
from ..models.training import fit_model
from ..operators.split import fold_column, hash_cuts
from .training import PARALLEL_FITS, _score

SIZES = tuple(i / 10 for i in range(1, 11))


def learning_curve(
    df: DataFrame,
    target: str,
    model_type: str = "random_forest_classifier",
    keys: Sequence[str] | None = None,
    params: dict | None = None,
    sizes: Sequence[float] = SIZES,
    folds: int = 5,
    seed: int = 42,
    parallel: int = PARALLEL_FITS,
) -> DataFrame:
    """(share, train_mean, train_std, validation_mean, validation_std) over the folds, numeric features only.

    Each size is a prefix of the training fold along the hash order, so larger sizes contain smaller ones.
    """
    require(df, target)
    keys = list(keys) if keys else list(df.columns)
    # without a key every numeric column is a feature
    features = [c for c in numeric_columns(df) if c != target and (len(keys) == len(df.columns) or c not in keys)]
    if params is None and model_type == "random_forest_classifier":
        params = {"n_estimators": 10}
    classification = is_classifier(model_type)
    scoring = "accuracy" if classification else "r2"
    stratify = target if classification else None
    rows = fold_column(df, keys, folds, stratify, seed, name="__fold")
    ordered = sorted(sizes)
    rows = hash_cuts(
        rows, keys, ordered[:-1], lambda n: [int(round(n * s / ordered[-1])) for s in ordered[:-1]], "__slice",
        stratify, seed + 1,
    ) if len(ordered) > 1 else rows.withColumn("__slice", F.lit(0))
    rows = rows.persist()

    def one(task: tuple[int, int]) -> tuple[float, float]:
        size, held = task
        train = rows.where((col("__fold") != held) & (col("__slice") <= size))
        model = fit_model(train, target, model_type, params, features)
        return (
            _score(model.transform(train), model, scoring),
            _score(model.transform(rows.where(col("__fold") == held)), model, scoring),
        )

    try:
        tasks = list(product(range(len(ordered)), range(folds)))
        with ThreadPool(min(parallel, len(tasks))) as pool:
            flat = pool.map(one, tasks)
    finally:
        rows.unpersist()
    out = []
    for i, size in enumerate(ordered):
        scores = np.array(flat[i * folds:(i + 1) * folds])
        out.append((size, *[float(f(scores[:, j])) for j in (0, 1) for f in (np.mean, np.std)]))
    return df.sparkSession.createDataFrame(
        out, "share double, train_mean double, train_std double, validation_mean double, validation_std double"
    )
