"""Evaluation metrics from aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, double, require, require_numeric
from ..session import freeze
from .ordered import running_sums

CLIP = 2.220446049250313e-16


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(label, prediction, count) over the pairs that occur."""
    require(df, label, prediction)
    return df.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("count")
    )


def per_class(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(class, precision, recall, f1, support, predicted, hits) from the confusion table; 0/0 is 0."""
    cells = confusion_matrix(df, label, prediction)
    # each cell counts once for its label and once for its prediction: no self-join needed
    sides = F.array(
        F.struct(
            col("label").alias("class"), F.col("count").alias("support"), F.lit(0).cast("long").alias("predicted"),
            F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0).alias("hits"),
        ),
        F.struct(
            col("prediction").alias("class"), F.lit(0).cast("long").alias("support"),
            F.col("count").alias("predicted"), F.lit(0).cast("long").alias("hits"),
        ),
    )
    sums = cells.select(F.explode(sides).alias("s")).select("s.*").groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )
    precision, recall = ratio(F.col("hits"), F.col("predicted")), ratio(F.col("hits"), F.col("support"))
    scored = sums.withColumns({"precision": precision, "recall": recall})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return scored.withColumn("f1", f1)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall and F1."""
    classes = per_class(df, label, prediction)
    n = F.sum("support")
    weighted = lambda c: F.try_divide(F.sum(F.col(c) * F.col("support")), n)
    return classes.agg(
        F.try_divide(F.sum("hits"), n).alias("accuracy"), weighted("precision").alias("precision"),
        weighted("recall").alias("recall"), weighted("f1").alias("f1_score"), n.alias("n"),
    )


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows per class plus macro avg, weighted avg and accuracy."""
    classes = per_class(df, label, prediction).select(
        F.col("class").cast("string").alias("class"), "precision", "recall", "f1", "support", "hits"
    )
    classes = freeze(classes, "classes")  # one row per class, read twice
    n = F.sum("support")
    summary = classes.agg(
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[F.try_divide(F.sum(F.col(c) * F.col("support")), n).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
        F.try_divide(F.sum("hits"), n).alias("accuracy"), n.alias("support"),
    )

    def row(name: str, *values) -> Column:
        parts = zip(("precision", "recall", "f1"), values)
        return F.struct(F.lit(name).alias("class"), *[F.col(v).alias(c) for c, v in parts], F.col("support"))

    extra = F.array(
        row("macro avg", "macro_precision", "macro_recall", "macro_f1"),
        row("weighted avg", "weighted_precision", "weighted_recall", "weighted_f1"),
        row("accuracy", "accuracy", "accuracy", "accuracy"),
    )
    return classes.drop("hits").unionByName(summary.select(F.explode(extra).alias("r")).select("r.*"))


def averaged_metrics(df: DataFrame, label: str, prediction: str, positive=1) -> DataFrame:
    """Binary metrics of the positive class with at most two classes, weighted ones otherwise."""
    classes = per_class(df, label, prediction)
    n = F.sum("support")
    binary = F.count(F.lit(1)) <= 2
    out = []
    for name, c in (("precision", "precision"), ("recall", "recall"), ("f1_score", "f1")):
        chosen = F.sum(F.when(F.col("class") == F.lit(positive), F.col(c)).otherwise(0.0))
        out.append(F.when(binary, chosen).otherwise(F.try_divide(F.sum(F.col(c) * F.col("support")), n)).alias(name))
    return classes.agg(F.try_divide(F.sum("hits"), n).alias("accuracy"), *out)


def regression_metrics(df: DataFrame, label: str, prediction: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """mse, rmse, mae and r2 in one pass, optionally per group."""
    require_numeric(df, label, prediction)
    y, p = double(df, label), double(df, prediction)
    e = y - p
    mse, spread = F.avg(e * e), F.var_pop(y)
    r2 = F.when(spread == 0, F.when(mse == 0, 1.0).otherwise(0.0)).otherwise(1 - mse / spread)
    return df.groupBy(*[col(k) for k in keys]).agg(
        mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae"), r2.alias("r2_score"),
        F.count(e).alias("n"),
    )


def log_loss(df: DataFrame, label: str, probability: str, eps: float = CLIP) -> DataFrame:
    """Binary cross-entropy with probabilities clipped away from 0 and 1."""
    require_numeric(df, label, probability)
    p = F.least(F.greatest(double(df, probability), F.lit(eps)), F.lit(1 - eps))
    y = double(df, label)
    return df.agg((-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def mape(df: DataFrame, label: str, prediction: str, eps: float = CLIP) -> DataFrame:
    require_numeric(df, label, prediction)
    y, p = double(df, label), double(df, prediction)
    return df.agg(F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(eps))).alias("mape"))


def prediction_statistics(df: DataFrame, prediction: str) -> DataFrame:
    p = double(df, prediction)
    return df.agg(
        F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"), F.min(p).alias("min"), F.max(p).alias("max")
    )


# --- curves -------------------------------------------------------------------------------------


def score_totals(df: DataFrame, label: str, score: str, **options) -> DataFrame:
    """(score, pos, neg, tp, fp): class counts per distinct score with running totals from the top."""
    require_numeric(df, label, score)
    y, s = double(df, label), double(df, score)
    counts = df.where(y.isNotNull() & s.isNotNull()).groupBy(s.alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y != 1).alias("neg")
    )
    return running_sums(counts, [F.desc("score")], {"tp": "pos", "fp": "neg"}, **options)


def class_totals(df: DataFrame, label: str, score: str) -> tuple[int, int]:
    y, s = double(df, label), double(df, score)
    both = y.isNotNull() & s.isNotNull()
    return tuple(df.agg(F.count_if(both & (y == 1)), F.count_if(both & (y != 1))).first())


def roc_curve(df: DataFrame, label: str, score: str, **options) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, preceded by the origin at infinity."""
    pos, neg = class_totals(df, label, score)
    if not pos or not neg:
        raise ValueError("a ROC curve needs both classes")
    points = score_totals(df, label, score, **options).select(
        F.col("score").alias("threshold"), (F.col("fp") / neg).alias("fpr"), (F.col("tp") / pos).alias("tpr")
    )
    start = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return start.unionByName(points)


def roc_auc(df: DataFrame, label: str, score: str, **options) -> DataFrame:
    """Area under the ROC curve by trapezoids over distinct scores (ties count half)."""
    totals = score_totals(df, label, score, **options)
    # a negative at this score loses to all positives above it and half-ties with those beside it
    area = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2))
    pos, neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    return totals.agg(F.when((pos > 0) & (neg > 0), area / (pos * neg)).alias("roc_auc"))


def pr_curve(df: DataFrame, label: str, score: str, **options) -> DataFrame:
    """(threshold, precision, recall) at every distinct score, then the final point (null, 1, 0)."""
    pos, _ = class_totals(df, label, score)
    if not pos:
        raise ValueError("a precision-recall curve needs positive rows")
    points = score_totals(df, label, score, **options).select(
        F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / pos).alias("recall"),
    )
    end = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def threshold_optimize(df: DataFrame, label: str, score: str, **options) -> DataFrame:
    """The score cut-off with the best F1, ties to the higher cut-off."""
    curve = pr_curve(df, label, score, **options).where(F.col("threshold").isNotNull())
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    best = curve.withColumn("f1", f1).agg(F.max(F.struct("f1", "threshold", "precision", "recall")).alias("b"))
    return best.select("b.threshold", "b.f1", "b.precision", "b.recall")


def ecdf(df: DataFrame, column: str, **options) -> DataFrame:
    """(value, count, cumulative, share) over distinct values."""
    require_numeric(df, column)
    v = double(df, column)
    present = df.where(v.isNotNull())
    n = df.agg(F.count(v)).first()[0]
    counts = present.groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    running = running_sums(counts, [F.asc("value")], {"cumulative": "count"}, **options)
    return running.withColumn("share", F.col("cumulative") / F.lit(n))


# --- clustering quality -------------------------------------------------------------------------


def cluster_state(df: DataFrame, features: str, label: str, max_labels: int = 1000) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """(labels, sizes, vector sums, sums of squared norms) of the clusters: mergeable, one array for each task.

    Rows with a null label or vector take no part. The labels are bounded and checked.
    """
    require(df, features, label)
    rows = df.where(col(features).isNotNull() & col(label).isNotNull())
    width = rows.select(F.max(F.size(col(features)))).first()[0]
    if not width or width < 1:
        raise ValueError("no feature vectors")
    labels = [r[0] for r in rows.select(col(label)).distinct().limit(max_labels + 1).collect()]
    if len(labels) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    labels.sort()
    place = {v: i for i, v in enumerate(labels)}

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, squares = np.zeros(len(labels)), np.zeros((len(labels), width)), np.zeros(len(labels))
        for batch in batches:
            x, own = np.array(batch["x"].tolist(), dtype=float).reshape(len(batch), width), batch["label"].map(place).to_numpy()
            np.add.at(n, own, 1)
            np.add.at(sums, own, x)
            np.add.at(squares, own, (x * x).sum(axis=1))
        yield pd.DataFrame({"at": np.arange(len(labels)), "n": n, "s": list(sums), "q": squares})

    narrow = rows.select(col(features).cast("array<double>").alias("x"), col(label).alias("label"))
    parts = narrow.mapInPandas(add, "at int, n double, s array<double>, q double")
    sums = F.array(*[F.sum(F.col("s")[i]) for i in range(width)])
    found = {r["at"]: r for r in parts.groupBy("at").agg(F.sum("n").alias("n"), sums.alias("s"), F.sum("q").alias("q")).collect()}
    held = [found[i] for i in range(len(labels))]
    return labels, np.array([r["n"] for r in held]), np.array([r["s"] for r in held]), np.array([r["q"] for r in held])


def row_distances(df: DataFrame, features: str, label: str, state: tuple) -> DataFrame:
    """(label, own, silhouette): each row's squared distance to its centre, and its silhouette by squared distances.

    The mean distance of a row to a cluster follows from the cluster's state, so no pairs of rows are formed.
    """
    labels, n, sums, squares = state
    place = {v: i for i, v in enumerate(labels)}

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, own = np.array(batch["x"].tolist(), dtype=float).reshape(len(batch), -1), batch["label"].map(place).to_numpy()
            norm, rows = (x * x).sum(axis=1), np.arange(len(x))
            total = norm[:, None] * n - 2 * x @ sums.T + squares  # to all rows of each cluster
            inside = total[rows, own] / np.maximum(n[own] - 1, 1)
            mean = total / n
            mean[rows, own] = np.inf
            near = mean.min(axis=1) if len(labels) > 1 else np.full(len(x), np.nan)
            larger = np.maximum(inside, near)
            # a row alone in its cluster has 0
            value = np.where((n[own] > 1) & (larger > 0), np.divide(near - inside, larger, out=np.zeros_like(near), where=larger > 0), 0.0)
            gap = x - (sums / n[:, None])[own]
            yield pd.DataFrame({"label": batch["label"], "own": (gap * gap).sum(axis=1), "silhouette": value})

    rows = df.where(col(features).isNotNull() & col(label).isNotNull())
    narrow = rows.select(col(features).cast("array<double>").alias("x"), col(label).alias("label"))
    return narrow.mapInPandas(measure, f"label {df.schema[label].dataType.simpleString()}, own double, silhouette double")


def clustering_metrics(df: DataFrame, features: str, label: str, max_labels: int = 1000) -> DataFrame:
    """Calinski-Harabasz, Davies-Bouldin and the mean silhouette for an array column and a label column of any type."""
    state = cluster_state(df, features, label, max_labels)
    labels, n, sums, _ = state
    rows = row_distances(df, features, label, state)
    within = {
        r["label"]: r for r in rows.groupBy("label").agg(F.sum("own").alias("w"), F.avg(F.sqrt("own")).alias("s"), F.sum("silhouette").alias("v")).collect()
    }
    k, total, centres = len(labels), n.sum(), sums / n[:, None]
    between = float((n * ((centres - sums.sum(axis=0) / total) ** 2).sum(axis=1)).sum())
    inner = sum(r["w"] for r in within.values())
    ch = (between / (k - 1)) / (inner / (total - k)) if k > 1 and total > k and inner else None
    scatter = np.array([within[v]["s"] for v in labels])
    gaps = np.sqrt(np.stack([((centres - c) ** 2).sum(axis=1) for c in centres]))  # a bounded table of labels
    ratios = np.divide(scatter[:, None] + scatter, gaps, out=np.full(gaps.shape, -np.inf), where=gaps > 0)
    worst = [float(r.max()) for r in ratios if r.max() > -np.inf]
    db = sum(worst) / k if worst else None
    sil = sum(r["v"] for r in within.values()) / total if k > 1 else None
    return df.sparkSession.createDataFrame(
        [(k, int(total), *(None if v is None else float(v) for v in (ch, db, sil)))], "clusters long, n long, calinski_harabasz double, davies_bouldin double, silhouette double"
    )


def silhouette_by_label(df: DataFrame, features: str, label: str, max_labels: int = 1000) -> DataFrame:
    """(label, n, silhouette): size and mean silhouette of each cluster, by squared Euclidean distances."""
    rows = row_distances(df, features, label, cluster_state(df, features, label, max_labels))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("silhouette").alias("silhouette"))


def silhouette(df: DataFrame, features: str, label: str) -> float:
    """Mean silhouette with squared Euclidean distance."""
    return silhouette_by_label(df, features, label).agg(F.sum(F.col("silhouette") * F.col("n")) / F.sum("n")).first()[0]
