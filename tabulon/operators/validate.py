"""Drift, fairness, gates and thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, double, numeric_columns, require
from ..functions.probability import kolmogorov_pvalue
from .metrics import classification_metrics, regression_metrics
from ..session import freeze
from .ordered import running_sums
from .quantiles import counted_cells

MAX_GROUP_VALUES = 10
BIAS_GAP = 0.1
DOMINANT_IMPORTANCE = 0.8
#: default limits of the monitoring alerts (fixed values)
ALERT_LIMITS = {
    "accuracy_drop": 0.05,
    "prediction_drift": 0.1,
    "data_drift": 0.1,
    "error_rate": 0.05,
}
#: default metric floors (fixed values)
PERFORMANCE_THRESHOLDS = {
    "accuracy": 0.85,
    "precision": 0.80,
    "recall": 0.80,
    "f1_score": 0.80,
    "roc_auc": 0.85,
}


def drift_ks(
    reference: DataFrame, new: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.1, **options
) -> DataFrame:
    """(column, n, m, ks_statistic, p_value, drift): two-sample Kolmogorov-Smirnov per shared column.

    Both samples reduce to counts per (column, value); one running total over those covers all columns.
    """
    columns = [c for c in numeric_columns(reference) if c in new.columns] if columns is None else list(columns)
    require(reference, *columns)
    require(new, *columns)
    if not columns:
        raise ValueError("no shared numeric column")

    def cells(df: DataFrame, first: int) -> DataFrame:
        base = df.select(*[double(df, c).alias(f"v{i}") for i, c in enumerate(columns)])
        met = counted_cells(base, [], list(range(len(columns))))  # equal cells of a batch count together
        n, zero = F.col("n"), F.lit(0).cast("long")
        return met.select("c", F.col("v").alias("value"), (n if first else zero).alias("a"), (zero if first else n).alias("b"))

    names = F.array(*[F.lit(c) for c in columns])
    counts = cells(reference, 1).unionByName(cells(new, 0)).groupBy("c", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = counts.select(names[F.col("c")].alias("column"), "value", "a", "b")
    counts = freeze(counts, "counts")
    running = running_sums(counts, [F.asc("value")], {"ca": "a", "cb": "b"}, ["column"], frozen=True, **options)
    totals = counts.groupBy("column").agg(F.sum("a").alias("n"), F.sum("b").alias("m"))
    gap = F.abs(F.try_divide("ca", "n") - F.try_divide("cb", "m"))
    # totals holds one row per column
    d = running.join(F.broadcast(totals), "column").groupBy("column", "n", "m").agg(F.max(gap).alias("ks_statistic"))
    p = kolmogorov_pvalue(F.col("ks_statistic"), F.col("n"), F.col("m"))
    return d.withColumn("p_value", p).withColumn("drift", F.col("p_value") < threshold)


def performance_gate(runs: DataFrame, threshold: float = 0.85, metrics: str = "metrics", task: str = "task") -> DataFrame:
    """Add (primary_metric, value, passed) to a table of runs with a metric map and a task.

    Classification uses f1_score, else accuracy; regression r2_score, else mse, where lower is better.
    """
    m = col(metrics)

    def first_known(*names: str) -> Column:
        chosen = F.lit(None).cast("string")
        for name in reversed(names):
            chosen = F.when(F.element_at(m, F.lit(name)).isNotNull(), F.lit(name)).otherwise(chosen)
        return chosen

    primary = F.when(col(task) == "classification", first_known("f1_score", "accuracy")).otherwise(
        first_known("r2_score", "mse")
    )
    out = runs.withColumn("primary_metric", primary).withColumn("value", F.element_at(m, F.col("primary_metric")))
    meets = F.when(F.col("primary_metric") == "mse", F.col("value") <= threshold).otherwise(F.col("value") >= threshold)
    return out.withColumn("passed", F.coalesce(meets, F.lit(False)))


def threshold_check(metrics: DataFrame, thresholds: dict[str, float] = PERFORMANCE_THRESHOLDS) -> DataFrame:
    """(metric, value, threshold, meets_threshold) for the metrics that exist, from a one-row table."""
    names = [c for c in thresholds if c in metrics.columns]
    if not names:
        return metrics.sparkSession.createDataFrame([], "metric string, value double, threshold double, meets_threshold boolean")
    cells = [
        F.struct(
            F.lit(c).alias("metric"), col(c).cast("double").alias("value"), F.lit(float(thresholds[c])).alias("threshold"),
            (col(c) >= thresholds[c]).alias("meets_threshold"),
        )
        for c in names
    ]
    return metrics.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("value IS NOT NULL")


def explainability_check(importance: DataFrame) -> DataFrame:
    """One row from (feature, importance): the dominant feature, a warning above 0.8, the unused features."""
    top = F.max_by("feature", F.struct("importance", "feature"))
    return importance.agg(
        F.max("importance").alias("max_importance"), top.alias("dominant_feature"),
        (F.max("importance") > DOMINANT_IMPORTANCE).alias("dominant_warning"),
        F.sort_array(F.collect_list(F.when(F.col("importance") == 0, F.col("feature")))).alias("zero_importance_features"),
    )


def fairness(
    df: DataFrame, features: Sequence[str], label: str, prediction: str, limit: float = BIAS_GAP
) -> DataFrame:
    """(feature, group, score, difference, potential_bias) for sensitive features of at most ten values.

    The score is accuracy when the label has at most ten values, R2 otherwise. All features and groups come from one
    aggregation. A feature of one group or of more than ten has one row, whose group is "skipped".
    """
    require(df, label, prediction, *features)
    if not features:
        raise ValueError("name at least one sensitive feature")
    few_labels = df.select(col(label)).distinct().limit(MAX_GROUP_VALUES + 1).count() <= MAX_GROUP_VALUES
    parts = [F.struct(F.lit(f).alias("feature"), col(f).cast("string").alias("group")) for f in features]
    rows = df.select(col(label).alias("y"), col(prediction).alias("p"), F.explode(F.array(*parts)).alias("x"))
    rows = rows.select("y", "p", "x.*").where(F.col("group").isNotNull())
    if few_labels:
        scores = rows.groupBy("feature", "group").agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("score"))
    else:
        scores = regression_metrics(rows, "y", "p", ("feature", "group")).select(
            "feature", "group", F.col("r2_score").alias("score")
        )
    scores = freeze(scores, "scores")
    # groups of a feature are few once checked, so the summary per feature is small
    summary = scores.groupBy("feature").agg(
        F.count(F.lit(1)).alias("groups"), (F.max("score") - F.min("score")).alias("difference")
    )
    fit = (F.col("groups") <= MAX_GROUP_VALUES) & (F.col("groups") > 1)
    judged = scores.join(F.broadcast(summary.where(fit)), "feature").select(
        "feature", "group", "score", "difference", (F.col("difference") > limit).alias("potential_bias")
    )
    skipped = summary.where(~fit).select(
        "feature", F.lit("skipped").alias("group"), F.lit(None).cast("double").alias("score"),
        F.lit(None).cast("double").alias("difference"), F.lit(None).cast("boolean").alias("potential_bias"),
    )
    return judged.unionByName(skipped)


def validation_report(
    scored: DataFrame, label: str, prediction: str, drift: DataFrame | None = None, threshold: float = 0.85,
    classification: bool = True,
) -> DataFrame:
    """One row: the metrics on validation data, the gate, the drift flag and the verdict."""
    if classification:
        metrics = classification_metrics(scored, label, prediction).select("accuracy", "f1_score")
        gate = F.col("f1_score") >= threshold
    else:
        metrics = regression_metrics(scored, label, prediction).select("r2_score", "mse")
        gate = F.col("r2_score") >= threshold
    found = False if drift is None else bool(drift.agg(F.coalesce(F.bool_or("drift"), F.lit(False))).first()[0])
    return metrics.withColumns(
        {"performance_valid": gate, "drift_detected": F.lit(found), "model_valid": gate & F.lit(not found)}
    )


def alert_thresholds(current: DataFrame, baseline: DataFrame, limits: dict[str, float] = ALERT_LIMITS) -> DataFrame:
    """(metric, baseline, current, change, limit, alert) for two (metric, value) tables.

    ``accuracy`` alerts on a fall, ``error_rate`` on its level, the drift metrics on any change. A metric of one table
    only keeps its row; rules that need the other value don't alert.
    """
    kind = {
        "accuracy": ("accuracy_drop", lambda b, c: b - c),
        "prediction_mean": ("prediction_drift", lambda b, c: F.abs(c - b) / F.greatest(F.abs(b), F.lit(1e-12))),
        "feature_mean": ("data_drift", lambda b, c: F.abs(c - b) / F.greatest(F.abs(b), F.lit(1e-12))),
        "error_rate": ("error_rate", lambda b, c: c),
    }
    both = baseline.withColumnRenamed("value", "baseline").join(
        current.withColumnRenamed("value", "current"), "metric", "full"
    )
    change, limit = F.lit(None).cast("double"), F.lit(None).cast("double")
    for metric, (name, rule) in kind.items():
        here = F.col("metric") == metric
        change = F.when(here, rule(F.col("baseline"), F.col("current"))).otherwise(change)
        limit = F.when(here, F.lit(limits[name])).otherwise(limit)
    out = both.withColumns({"change": change, "limit": limit})
    return out.withColumn("alert", F.coalesce(F.col("change") > F.col("limit"), F.lit(False)))
