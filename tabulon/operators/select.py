"""Univariate feature scores and top-k selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col, double, numeric_columns, require, require_numeric
from ..session import freeze
from .association import correlation
from .detect import classify_target
from .quantiles import column_quantiles

MAX_FEATURES = 50
MI_BINS = 10


def _class_sums(df: DataFrame, features: Sequence[str], target: str, square: bool) -> tuple[DataFrame, list[str]]:
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(features):
        v = double(df, c)
        aggs += [F.sum(v).alias(f"s{i}")] + ([F.sum(v * v).alias(f"q{i}"), F.count(v).alias(f"n{i}")] if square else [])
    return df.where(col(target).isNotNull()).groupBy(col(target).alias("__y")).agg(*aggs), list(features)


def _scores(row: DataFrame, features: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"f{i}").alias("score")) for i, c in enumerate(features)]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def f_classif(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """ANOVA F of every feature from per-class sums: one aggregation over the data.

    Sums are taken about the overall mean so that large offsets do not cancel.
    """
    require_numeric(df, *features)
    means = df.agg(*[F.avg(double(df, c)) for c in features]).first()
    aggs = []
    for i, (c, m) in enumerate(zip(features, means)):
        v = double(df, c) - F.lit(m or 0.0)
        aggs += [F.count(v).alias(f"n{i}"), F.sum(v).alias(f"s{i}"), F.sum(v * v).alias(f"q{i}")]
    per_class = df.where(col(target).isNotNull()).groupBy(col(target).alias("__y")).agg(*aggs)
    out = []
    for i in range(len(features)):
        n, s, q = F.col(f"n{i}"), F.col(f"s{i}"), F.col(f"q{i}")
        between = F.sum(F.try_divide(s * s, n)) - F.try_divide(F.sum(s) * F.sum(s), F.sum(n))
        within = F.sum(q) - F.sum(F.try_divide(s * s, n))
        groups = F.count_if(n > 0)
        score = F.try_divide(F.try_divide(between, groups - 1), F.try_divide(within, F.sum(n) - groups))
        out.append(score.alias(f"f{i}"))
    return _scores(per_class.agg(*out), features)


def f_regression(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Univariate F from the correlation with the target."""
    require_numeric(df, target, *features)
    y = double(df, target)
    out = []
    for i, c in enumerate(features):
        v = double(df, c)
        r = correlation(v, y)
        n = F.count(F.when(v.isNotNull() & y.isNotNull(), 1))
        out.append(F.try_divide(r * r * (n - 2), 1 - r * r).alias(f"f{i}"))
    return _scores(df.agg(*out), features)


def chi2(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Chi-square of per-class feature sums against the class shares; features must not be negative."""
    require_numeric(df, *features)
    lows = df.agg(*[F.min(double(df, c)) for c in features]).first()
    negative = [c for c, low in zip(features, lows) if low is not None and low < 0]
    if negative:
        raise ValueError(f"chi2 needs non-negative features: {', '.join(negative)}")
    sums, _ = _class_sums(df, features, target, square=False)
    # sum over classes of (o - e)^2 / e with e = share * total, written with plain sums
    out = []
    for i in range(len(features)):
        o = F.coalesce(F.col(f"s{i}"), F.lit(0.0))
        total = F.sum(o)
        out.append((F.try_divide(F.sum(o * o / F.col("n")) * F.sum("n"), total) - total).alias(f"f{i}"))
    return _scores(sums.agg(*out), features)


JOINT = pa.schema([("c", pa.int32()), ("b", pa.int32()), ("y", pa.large_string()), ("n", pa.int64())])


def _joint_cells(values: DataFrame, cuts: list[np.ndarray], target_cuts: np.ndarray | None) -> DataFrame:
    """(c, b, y, n): how often bin b of feature c (v0, v1, ...) meets the target y, counted in each batch of rows.

    With ``target_cuts`` the target is binned, too. A bin is the number of cuts below a value; missing values have none.
    """
    def binned(column: pa.Array, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = column.to_numpy(zero_copy_only=False)  # a missing value becomes NaN
        return np.searchsorted(edges, v, side="left"), np.isnan(v)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            if target_cuts is None:
                coded = batch.column("y").dictionary_encode()
                labels = coded.dictionary.cast(pa.large_string())
                own, missing = np.asarray(pc.fill_null(coded.indices, 0), np.int64), np.asarray(pc.is_null(coded.indices))
            else:
                labels = pa.array([str(i) for i in range(len(target_cuts) + 1)], pa.large_string())
                own, missing = binned(batch.column("y"), target_cuts)
            for i, edges in enumerate(cuts):
                place, absent = binned(batch.column(f"v{i}"), edges)
                both = ~(missing | absent)
                met, n = np.unique(place[both] * max(1, len(labels)) + own[both], return_counts=True)
                place, own_place = np.divmod(met, max(1, len(labels)))
                columns = [np.full(len(n), i, np.int32), place.astype(np.int32), labels.take(pa.array(own_place)), n]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(columns, JOINT)], schema=JOINT)

    return values.mapInArrow(count, "c int, b int, y string, n long")


def mutual_information(
    df: DataFrame, features: Sequence[str], target: str, classification: bool = True, bins: int = MI_BINS
) -> DataFrame:
    """Mutual information of equal-frequency bins with the target (binned too when continuous).

    One scan yields the joint counts of all features, counted by batch; everything after works on those counts.
    """
    require(df, target)
    require_numeric(df, *features)
    probs = [i / bins for i in range(1, bins)]
    numeric_target = [] if classification else [target]
    edges = column_quantiles(df, [*features, *numeric_target], probs)

    cuts = {c: np.array(sorted({e for e in edges[c] if e is not None})) for c in edges}
    y = col(target).cast("string") if classification else double(df, target)
    values = df.select(y.alias("y"), *[double(df, c).alias(f"v{i}") for i, c in enumerate(features)])
    cells = _joint_cells(values, [cuts[c] for c in features], None if classification else cuts[target])
    names = F.array(*[F.lit(c) for c in features])
    joint = cells.groupBy("c", "b", "y").agg(F.sum("n").alias("n")).select(names[F.col("c")].alias("feature"), "b", "y", "n")
    joint = freeze(joint, "joint")  # at most features x bins x classes rows, read four times
    by_bin = joint.groupBy("feature", "b").agg(F.sum("n").alias("nb"))
    by_y = joint.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    total = joint.groupBy("feature").agg(F.sum("n").alias("nt"))
    cell = joint.join(by_bin, ["feature", "b"]).join(by_y, ["feature", "y"]).join(F.broadcast(total), "feature")
    term = F.col("n") / F.col("nt") * F.log(F.col("n") * F.col("nt") / (F.col("nb") * F.col("ny")))
    return cell.groupBy("feature").agg(F.sum(term).alias("score"))


def feature_scores(df: DataFrame, target: str, method: str = "mutual_info", features: Sequence[str] | None = None) -> DataFrame:
    """(feature, score) by the chosen method; the task follows the target."""
    require(df, target)
    features = [c for c in numeric_columns(df) if c != target] if features is None else list(features)
    if method == "chi2":
        return chi2(df, features, target)
    if method not in ("mutual_info", "f_score"):
        raise ValueError(f"unknown feature selection method: {method}")
    classification = classify_target(df, target, "selection")
    if method == "mutual_info":
        return mutual_information(df, features, target, classification)
    return f_classif(df, features, target) if classification else f_regression(df, features, target)


def ranked_features(df: DataFrame, target: str, method: str = "mutual_info", k: int = MAX_FEATURES) -> DataFrame:
    """(feature, score, rank, selected) over all candidate features: one row per column of the table."""
    from pyspark.sql import Window

    scores = feature_scores(df, target, method)
    order = Window.orderBy(F.desc_nulls_last("score"), F.asc("feature"))
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).withColumn(
        "selected", F.col("rank") <= k
    )


def select_features(df: DataFrame, target: str, method: str = "mutual_info", k: int = MAX_FEATURES) -> list[str]:
    """Names of the k best features, in table order."""
    kept = {r["feature"] for r in ranked_features(df, target, method, k).where("selected").collect()}
    return [c for c in df.columns if c in kept]


def select_kbest(df: DataFrame, target: str, method: str = "mutual_info", k: int = MAX_FEATURES) -> DataFrame:
    return df.select(*[col(c) for c in select_features(df, target, method, k)], col(target))
