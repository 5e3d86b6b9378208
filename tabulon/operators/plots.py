"""The tables behind the plot types."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col, double, missing, numeric_columns, require, require_numeric, unused
from ..functions.hashing import key_text
from .association import chi2_pvalues, correlation_matrix, crosstab
from .clean import drop_missing
from .profile import target_mean, value_counts
from .quantiles import quantiles

HISTOGRAM_BINS = 30
DENSITY_POINTS = 500
MAX_CURVES = 200
#: plot type -> (operator, needed columns); fixed list of the supported types
PLOT_TYPES = (
    "histogram", "scatter", "correlation_matrix", "boxplot", "pairplot", "violin", "kde", "countplot", "pie",
    "target_mean", "stacked_bar", "chi_squared_heatmap", "pca_scatter", "class_imbalance", "learning_curve",
)


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bin, low, high, count) over equal-width bins from min to max, the last one closed."""
    require_numeric(df, column)
    v = double(df, column)
    low, high = df.agg(F.min(v), F.max(v)).first()
    if low is None:
        return df.sparkSession.range(0).selectExpr(
            "CAST(id AS INT) AS bin", "CAST(id AS DOUBLE) AS low", "CAST(id AS DOUBLE) AS high", "id AS count"
        )
    width = (high - low) / bins or 1.0
    index = F.least(F.floor((v - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.where(v.isNotNull()).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = grid.join(F.broadcast(counts), "bin", "left")  # at most one row per bin
    return full.select(
        "bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
        F.coalesce("count", F.lit(0).cast("long")).alias("count"),
    )


def sample_rows(df: DataFrame, rows: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """The ``rows`` rows whose keys come first by md5: the same ones however the table is partitioned.

    Each task keeps its first rows and the tasks' firsts are merged, in one pass. Keys identify a row; equal keys are told
    apart by all columns.
    """
    require(df, *keys)
    order = [F.md5(F.concat_ws("|", key_text(keys), F.lit(str(seed)))), *[col(k) for k in keys]]
    return df.orderBy(*order, F.xxhash64(*[col(c) for c in df.columns])).limit(rows)


def scatter(
    df: DataFrame, x: str, y: str, color: str | None = None, max_rows: int | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """x, y and the colour of every row, or of a sample of ``max_rows`` by the hash of ``keys`` (all columns without any)."""
    require(df, x, y)
    if max_rows is not None:
        df = sample_rows(df, max_rows, list(keys) or df.columns)
    extra = [col(color).alias("color")] if color in df.columns else []
    return df.select(col(x).alias("x"), col(y).alias("y"), *extra)


def pair_columns(
    df: DataFrame, top_k: int | None = None, color: str | None = None, max_rows: int | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """The columns of a scatter matrix side by side: one row per point serves every panel."""
    names = [c for c in numeric_columns(df) if c not in keys][:top_k]
    if max_rows is not None:
        df = sample_rows(df, max_rows, list(keys) or df.columns)
    extra = [col(color).alias("color")] if color in df.columns else []
    return df.select(*[col(c) for c in names], *extra)


def pair_points(
    df: DataFrame, top_k: int | None = None, color: str | None = None, max_rows: int | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """(x_column, y_column, x, y[, color]): the points of every panel above the diagonal of a scatter matrix."""
    wide = pair_columns(df, top_k, color, max_rows, keys)
    names = [c for c in numeric_columns(df) if c not in keys][:top_k]
    panels = [
        F.struct(F.lit(a).alias("x_column"), F.lit(b).alias("y_column"), double(wide, a).alias("x"), double(wide, b).alias("y"))
        for i, a in enumerate(names) for b in names[i + 1 :]
    ]
    extra = ["color"] if color in df.columns else []
    kind = "array<struct<x_column: string, y_column: string, x: double, y: double>>"
    return wide.select(F.explode(F.array(*panels).cast(kind)).alias("p"), *extra).select("p.*", *extra)


def box(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """Five numbers, whisker fences and outlier count of x, or of y per value of x."""
    value, keys = (y, [x]) if y and y in df.columns else (x, [])
    require_numeric(df, value)
    source = df.where(~missing(df, x)) if keys else df
    found = quantiles(source, {value: (0.0, 0.25, 0.5, 0.75, 1.0)}, keys)
    rows = []
    for group, per in found.items():
        lo, q1, med, q3, hi = per[value]
        if lo is not None:
            reach = 1.5 * (q3 - q1)
            rows.append((*group, lo, q1, med, q3, hi, q1 - reach, q3 + reach))
    fields = ["min", "q1", "median", "q3", "max", "low_fence", "high_fence"]
    key_type = [f"x {df.schema[x].dataType.simpleString()}"] if keys else []
    side = df.sparkSession.createDataFrame(rows, ", ".join([*key_type, *[f"{f} double" for f in fields]]))
    v = double(source, value)
    points = source.select(*[col(k).alias("x") for k in keys], v.alias("__v"))
    if keys:
        joined = points.join(F.broadcast(side), "x")  # bounded: one row per box
    else:
        joined = points.withColumns({f: F.lit(r).cast("double") for f, r in zip(fields, rows[0] if rows else [None] * 7)})
    outside = (F.col("__v") < F.col("low_fence")) | (F.col("__v") > F.col("high_fence"))
    return joined.groupBy(*(["x"] if keys else []), *fields).agg(
        F.count("__v").alias("count"), F.count_if(outside).alias("outliers")
    )


#: Cells of the fine grid for each bandwidth, and bandwidths beyond which a kernel is 0.
FINE, REACH = 16, 9


def density(df: DataFrame, column: str, by: str | None = None, points: int = DENSITY_POINTS, exact: bool = False) -> DataFrame:
    """(point, grid, density): Gaussian kernel density with Scott bandwidth h over ``points`` places from min to max.

    Every value is split linearly between the two nearest places of a grid of step h / 16 (or finer, so that the places
    asked for are among them); one narrow aggregate counts the weights, and the kernel is summed over the grid. The error
    of a density is at most step^2 / 8 times the largest curvature of the kernel, that is 0.0002 / h. ``exact`` sums the
    kernel of each row at each place instead, whose time grows with rows times places. Groups come from ``by``.
    """
    require_numeric(df, column)
    keys = [by] if by else []
    source = df.where(~missing(df, by)) if by else df
    v = double(source, column)
    group = (col(by) if by else F.lit(None).cast("int")).alias("x")
    fit = source.groupBy(group).agg(
        F.count(v).alias("n"), F.stddev_samp(v).alias("s"), F.min(v).alias("low"), F.max(v).alias("high")
    ).limit(MAX_CURVES + 1).collect()
    if len(fit) > MAX_CURVES:
        raise ValueError(f"more than {MAX_CURVES} groups")
    x_type = df.schema[by].dataType.simpleString() if by else "int"
    spec = [(r["x"], r["low"], r["high"], r["n"], r["s"] * r["n"] ** -0.2) for r in fit if r["n"] > 1 and r["s"]]
    narrow = source.where(v.isNotNull()).select(group, v.alias("v"))
    totals = _kernel_sums(narrow, spec, points, x_type) if exact else _binned_sums(narrow, spec, points, x_type)
    rows = []
    for x, low, high, n, h in spec:
        heights = totals[x] / (n * h * np.sqrt(2 * np.pi))
        rows += [(x, p, low + p * (high - low) / (points - 1), float(heights[p])) for p in range(points)]
    out = df.sparkSession.createDataFrame(rows, f"x {x_type}, point int, grid double, density double")  # points for each group
    return out if by else out.drop("x")


def _binned_sums(narrow: DataFrame, spec: list[tuple], points: int, x_type: str) -> dict:
    """Kernel sums at the places of each group, from linear weights on a fine grid."""
    spark = narrow.sparkSession
    grids = {}
    for x, low, high, n, h in spec:
        between = max(1, int(np.ceil((high - low) / (points - 1) / (h / FINE))))  # fine steps from one place to the next
        grids[x] = (low, (high - low) / (points - 1) / between, between, h)
    sides = [(x, low, step, between, REACH * h) for x, (low, step, between, h) in grids.items()]
    side = spark.createDataFrame(sides, f"gx {x_type}, low double, step double, between long, reach double")
    met = narrow.join(F.broadcast(side), F.col("x").eqNullSafe(F.col("gx")))  # one row for each group
    fine = (F.col("v") - F.col("low")) / F.col("step")
    place = F.round(fine / F.col("between")) * F.col("between")
    # far from every place, as outliers stretch the grid, a value adds nothing: at most 2 * REACH * FINE cells for each place
    near = met.where(F.abs(fine - place) * F.col("step") <= F.col("reach") + F.col("step"))
    at = F.floor(fine)
    # both neighbours of a cell from the same two sums: rows, and parts of a step
    cells: dict = {x: [] for x in grids}
    for r in near.groupBy("x", at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.sum(fine - at).alias("part")).collect():
        cells[r["x"]].append((r["at"], r["n"], r["part"]))
    out = {}
    for x, (low, step, between, h) in grids.items():
        cell, n, part = (np.array(c, dtype=float) for c in zip(*sorted(cells[x])))
        where, weight = np.concatenate([cell, cell + 1]), np.concatenate([n - part, part])
        order = np.argsort(where, kind="stable")
        where, weight = where[order], weight[order]
        middle, reach = np.arange(points) * between, REACH * h / step
        first, last = np.searchsorted(where, middle - reach), np.searchsorted(where, middle + reach, "right")
        out[x] = np.array([
            (weight[a:b] * np.exp(-0.5 * ((where[a:b] - m) * step / h) ** 2)).sum() for m, a, b in zip(middle, first, last, strict=True)
        ])
    return out


def _kernel_sums(narrow: DataFrame, spec: list[tuple], points: int, x_type: str) -> dict:
    """Kernel sums at the places of each group, row by row; each task adds up its own."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places = {x: (np.linspace(low, high, points), h) for x, low, high, _, h in spec}
        sums = {x: np.zeros(points) for x in places}
        for batch in batches:
            for x, own in batch.groupby("x", dropna=False)["v"] if x_type != "int" or batch["x"].notna().any() else [(None, batch["v"])]:
                if x in places:
                    grid, h = places[x]
                    values = own.to_numpy()
                    for start in range(0, len(values), 4096):
                        z = (grid[None, :] - values[start : start + 4096, None]) / h
                        sums[x] += np.exp(-0.5 * z * z).sum(axis=0)
        for x, total in sums.items():
            yield pd.DataFrame({"x": [x] * points, "point": np.arange(points, dtype="int32"), "total": total})

    summed = narrow.mapInPandas(add, f"x {x_type}, point int, total double").groupBy("x", "point").agg(F.sum("total").alias("total"))
    out: dict = {x: np.zeros(points) for x, *_ in spec}
    for r in summed.collect():  # points for each group
        out[r["x"]][r["point"]] = r["total"]
    return out


def violin(df: DataFrame, x: str, y: str | None = None, points: int = DENSITY_POINTS, exact: bool = False) -> DataFrame:
    """Density curve with the box numbers of its group beside it."""
    boxes = box(df, x, y)
    if y and y in df.columns:
        return density(df, y, by=x, points=points, exact=exact).join(F.broadcast(boxes), "x")
    curve = density(df, x, points=points, exact=exact)
    numbers = boxes.first()  # a single box
    return curve.withColumns({c: F.lit(numbers[c]) for c in boxes.columns})


def pie(df: DataFrame, column: str) -> DataFrame:
    """(value, count, share) with the share of all present rows."""
    counts = value_counts(df, column)
    total = df.agg(F.count(F.when(~missing(df, column), 1))).first()[0]
    return counts.withColumn("share", F.try_divide("count", F.lit(total)))


def principal_components(
    df: DataFrame, color: str | None = None, columns: Sequence[str] | None = None, k: int = 2
) -> DataFrame:
    """PC1, PC2 of the centred, unscaled numeric columns and the shares of variance they explain.

    Rows with a missing number are dropped together with their colour; the sign makes the largest
    loading of each component positive.
    """
    columns = numeric_columns(df) if columns is None else list(columns)
    if len(columns) < 2:
        raise ValueError("principal components need at least 2 numeric columns")
    full = drop_missing(df, columns)
    raw, centred, pcs = (unused(df.columns, n) for n in ("__raw", "__centred", "__pcs"))
    assembled = VectorAssembler(inputCols=columns, outputCol=raw).transform(full)
    center = StandardScaler(inputCol=raw, outputCol=centred, withMean=True, withStd=False).fit(assembled)
    moved = center.transform(assembled)
    model = PCA(k=k, inputCol=centred, outputCol=pcs).fit(moved)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.argmax(np.abs(loadings[:, j])), j] >= 0 else -1.0 for j in range(k)]
    shares = model.explainedVariance.toArray()
    values = vector_to_array(F.col(pcs))
    extra = [col(color).alias("color")] if color in df.columns else []
    return model.transform(moved).select(
        *[(values[j] * F.lit(signs[j])).alias(f"PC{j + 1}") for j in range(k)],
        *[F.lit(float(shares[j])).alias(f"explained_{j + 1}") for j in range(k)], *extra,
    )


def residuals(df: DataFrame, label: str, prediction: str) -> DataFrame:
    require_numeric(df, label, prediction)
    y, p = double(df, label), double(df, prediction)
    return df.select(p.alias("prediction"), (y - p).alias("residual"))


def actual_vs_predicted(df: DataFrame, label: str, prediction: str) -> DataFrame:
    require_numeric(df, label, prediction)
    return df.select(double(df, label).alias("actual"), double(df, prediction).alias("predicted"))


def residual_histogram(df: DataFrame, label: str, prediction: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    return histogram(residuals(df, label, prediction), "residual", bins)


def plot_table(df: DataFrame, plot: str, x: str | None = None, y: str | None = None, color: str | None = None, **options) -> DataFrame:
    """The table for a plot type by name."""
    from ..plans.learning_curve import learning_curve

    tables = {
        "histogram": lambda: histogram(df, x, **options),
        "scatter": lambda: scatter(df, x, y, color),
        "correlation_matrix": lambda: correlation_matrix(df),
        "boxplot": lambda: box(df, x, y),
        "pairplot": lambda: pair_columns(df, options.get("top_k"), color),
        "violin": lambda: violin(df, x, y, **options),
        "kde": lambda: density(df, x, **options),
        "countplot": lambda: value_counts(df, x),
        "pie": lambda: pie(df, x),
        "target_mean": lambda: target_mean(df, x, y),
        "stacked_bar": lambda: crosstab(df, x, y),
        "chi_squared_heatmap": lambda: chi2_pvalues(df),
        "pca_scatter": lambda: principal_components(df, color),
        "class_imbalance": lambda: value_counts(df, x),
        "learning_curve": lambda: learning_curve(df, x, **options),
    }
    if plot not in tables:
        raise ValueError(f"plot type {plot!r} is not supported")
    needed = {"histogram": [x], "scatter": [x, y], "boxplot": [x], "violin": [x], "kde": [x], "countplot": [x],
              "pie": [x], "target_mean": [x, y], "stacked_bar": [x, y], "class_imbalance": [x], "learning_curve": [x]}
    if any(c is None for c in needed.get(plot, [])):
        raise ValueError(f"plot type {plot!r} needs more columns")
    return tables[plot]()


def plot_batch(df: DataFrame, requests: Sequence[dict]) -> tuple[dict[int, DataFrame], dict[int, str]]:
    """Several plot tables at once: (tables by position, errors by position)."""
    tables, errors = {}, {}
    for i, request in enumerate(requests):
        try:
            tables[i] = plot_table(df, **request)
        except Exception as error:  # a bad request must not stop the others
            errors[i] = str(error)
    return tables, errors
