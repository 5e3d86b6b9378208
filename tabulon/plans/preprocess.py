"""Lists of preprocessing steps, recommendations, and the offline preparation chain."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import col, double, literal, numeric_columns, quoted, require, require_numeric, text_columns, unused
from ..functions.projection import Projection
from ..operators.clean import clean_column, dedupe, delete_columns, iqr_filter
from ..operators.construct import fit_interaction, fit_polynomial
from ..operators.encode import categories, encode, fit_onehot, shrunk_mean, target_cells, target_encode_crossfit
from ..operators.impute import impute, impute_table
from ..operators.profile import iqr_outlier_pct, null_counts, numeric_ranges, nunique, shape
from ..operators.scale import fit_scaler, scale
from ..operators.select import MAX_FEATURES, select_features
from ..session import freeze
from ..sources.files import write_table


@dataclass
class Outcome:
    """A processed table with what was done and what failed."""

    data: DataFrame
    applied: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    columns_before: list[str] = field(default_factory=list)

    @property
    def columns_after(self) -> list[str]:
        return self.data.columns

    def shapes(self, before: DataFrame) -> DataFrame:
        """Row and column counts before and after."""
        return shape(before).withColumn("state", F.lit("before")).unionByName(
            shape(self.data).withColumn("state", F.lit("after"))
        )


def _step(df: DataFrame, operation: str, column: str, categorical: bool, method: str | None) -> DataFrame:
    if operation == "imputation":
        return impute(df, column, method or "mean", categorical)
    if operation == "encoding":
        return encode(df, column, method or "one-hot")
    if operation == "normalization":
        require_numeric(df, column)
        return scale(df, [column], method or "z-score")
    if operation == "deletion":
        require(df, column)
        return delete_columns(df, [column])
    return clean_column(df, column)


OPERATIONS = ("imputation", "encoding", "normalization", "cleaning", "deletion")
#: What a failed step reports.
UNKNOWN, FAILED = "Unknown operation: {operation}", "Error processing {operation} on {column}: {error}"


def apply_preprocessing(
    df: DataFrame, steps: dict[str, str] | Iterable[tuple], categorical: bool = False
) -> Outcome:
    """Apply (operation, column[, method]) steps in order; a failing step is reported and the rest go on."""
    outcome = Outcome(df, columns_before=list(df.columns))
    for operation, column, *method in steps.items() if isinstance(steps, dict) else steps:
        if operation not in OPERATIONS:
            outcome.errors.append(UNKNOWN.format(operation=operation))
            continue
        try:
            outcome.data = _step(outcome.data, operation, column, categorical, method[0] if method else None)
            outcome.applied.append(f"{operation} on {column}")
        except Exception as error:  # errors are values here
            outcome.errors.append(FAILED.format(operation=operation, column=column, error=error))
    return outcome


def export_processed(df: DataFrame, steps, path: str, fmt: str = "csv") -> Outcome:
    """Apply the steps and write the result; any error aborts before anything is written."""
    outcome = apply_preprocessing(df, steps)
    if outcome.errors:
        raise ValueError("; ".join(outcome.errors))
    write_table(outcome.data, path, fmt)
    return outcome


def recommend(df: DataFrame) -> DataFrame:
    """(operation, column, method, detail): what to impute, encode, scale and clean.

    Nulls and distinct counts, ranges, and quartile outliers each come from one pass over all columns.
    """
    numbers, texts = numeric_columns(df), text_columns(df)
    n = df.count()
    nulls = null_counts(df)
    share = F.col("nulls") / F.lit(n or 1) * 100
    numeric = F.col("column").isin(numbers) if numbers else F.lit(False)
    imputation = nulls.where("nulls > 0").select(
        F.when(numeric & (share >= 20), "deletion").otherwise("imputation").alias("operation"), "column",
        F.when(~numeric, "mode").when(share < 5, "mean").when(share < 20, "knn").otherwise("drop_column").alias("method"),
        share.alias("detail"),
    )
    out = imputation
    if texts:
        distinct = nunique(df, texts).withColumn("detail", F.col("distinct_values").cast("double"))
        out = out.unionByName(
            distinct.select(
                F.lit("encoding").alias("operation"), "column",
                F.when(F.col("detail") > 10, "label").otherwise("one-hot").alias("method"), "detail",
            )
        )
    if len(numbers) > 1:
        out = out.unionByName(
            numeric_ranges(df, numbers).where("ratio > 10").select(
                F.lit("normalization").alias("operation"), "column", F.lit("standard").alias("method"),
                F.col("ratio").alias("detail"),
            )
        )
    if numbers:
        out = out.unionByName(
            iqr_outlier_pct(df, numbers).where("outlier_pct > 5").select(
                F.lit("cleaning").alias("operation"), "column", F.lit("outlier_removal").alias("method"),
                F.col("outlier_pct").alias("detail"),
            )
        )
    return out


def prepare_data(
    df: DataFrame, strategy: str | None = "median", threshold: float | None = 1.5, remove_duplicates: bool = True,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Dedupe, impute every column, then drop quartile outliers column by column; ``keys`` are left alone.

    The deduplicated table is written once, since every fit after it passes over the rows again.
    """
    if remove_duplicates:
        df = freeze(dedupe(df), "unique")
    if strategy:
        df = impute_table(df, strategy, keys)
    if threshold is not None:
        df = iqr_filter(df, [c for c in numeric_columns(df) if c not in keys], threshold)
    return df


@dataclass
class Features:
    """Fitted feature engineering: ordered projections and the names that survive selection.

    ``apply`` is for rows that weren't fitted on. ``fitting`` holds the rows of the fit themselves, whose target encodings
    come from the other folds only, so that no row's features know its own target.
    """

    steps: list[Projection]
    selected: list[str]
    target: str
    originals: list[str]
    fitting: DataFrame | None = None

    def save(self, path: str) -> None:
        """Both outputs: the projections as JSON, the engineered rows of the fit as Parquet."""
        about = {
            "steps": [[s.columns, list(s.dropped), s.where] for s in self.steps], "selected": self.selected, "target": self.target,
            "originals": self.originals,
        }
        spark = self.fitting.sparkSession
        self.fitting.write.mode("overwrite").parquet(f"{path}/fitting")
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Features:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        steps = [Projection(columns, tuple(dropped), where) for columns, dropped, where in about.pop("steps")]
        return Features(steps, fitting=spark.read.parquet(f"{path}/fitting"), **about)

    def apply(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.apply(df)
        keep = [c for c in df.columns if c in self.selected]
        extra = [self.target] if self.target in df.columns else []
        return df.select(*[col(c) for c in [*keep, *extra]])

    def stages(self, input_columns: Sequence[str], spark) -> PipelineModel:
        """The same chain as one saveable model."""
        stages, names = [], list(input_columns)
        for step in self.steps:
            stages.append(step.stage(names))
            names = [n for n in names if n not in step.dropped] + [
                c for c in step.columns if c not in names or c in step.dropped
            ]
        return PipelineModel(stages=stages)


def _target_projection(df: DataFrame, columns: Sequence[str], target: str) -> Projection:
    """Codes from all rows, one aggregate for all columns."""
    y = double(df, target)
    mean, variance = df.agg(F.avg(y), F.var_pop(y)).first()
    code = shrunk_mean(F.col("n"), F.col("s"), F.col("q"), F.lit(mean), F.lit(variance))
    rows = target_cells(df, columns, target).select("c", "key", code.alias("code")).orderBy("c", "key").limit(MAX_INLINE * len(columns) + 1).collect()
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(r["c"], []).append((None if r["key"] == "n" else r["key"][1:], r["code"]))
    out = {}
    for i, c in enumerate(columns):
        own = found.get(i, [])
        if len(own) > MAX_INLINE or len(rows) > MAX_INLINE * len(columns):
            raise ValueError(f"column {c} has more than {MAX_INLINE} categories; encode it with target_encode")
        cases = " ".join(
            f"WHEN {quoted(c)} {'IS NULL' if v is None else '= ' + literal(v)} THEN {literal(code)}" for v, code in own
        )
        out[c] = f"CASE {cases} ELSE {literal(mean)} END" if cases else literal(mean)
    return Projection(out)


def _label_projection(df: DataFrame, columns: Sequence[str]) -> Projection:
    out = {}
    for c in columns:
        text = f"coalesce(CAST({quoted(c)} AS STRING), 'nan')"  # the codes of label_encode
        values = categories(df.select(F.expr(text).alias(c)), c, MAX_INLINE)
        out[c] = f"CAST(nullif(array_position(array({', '.join(map(literal, values))}), {text}), 0) - 1 AS DOUBLE)" if values else "CAST(NULL AS DOUBLE)"
    return Projection(out)


MAX_INLINE = 1000


def fit_features(
    train: DataFrame,
    target: str | None = None,
    encoding: str = "target",
    polynomial_degree: int | None = None,
    interactions: bool = True,
    scaling: str | None = "standard",
    selection: str | None = "mutual_info",
    max_features: int = MAX_FEATURES,
    keys: Sequence[str] = (),
    folds: int = 5,
) -> Features:
    """Fit encode -> polynomial -> interaction -> scale -> select on training rows only.

    Target encoding is cross-fitted: the later steps, and :attr:`Features.fitting`, see each row encoded from the other
    folds. ``keys`` identify rows and deal them to folds; without any, rows are numbered as they are read.
    """
    target = train.columns[-1] if target is None else target
    require(train, target)
    originals = [c for c in train.columns if c != target]
    steps: list[Projection] = []
    df = train

    def add(step: Projection) -> None:
        nonlocal df
        if step.columns:
            steps.append(step)
            df = step.apply(df)

    texts = [c for c in text_columns(df) if c != target]
    if texts:
        if encoding == "target" and target not in text_columns(df):
            steps.append(_target_projection(df, texts, target))
            number = unused(df.columns, "__row")
            rows = df if keys else freeze(df.withColumn(number, F.monotonically_increasing_id()), "numbered")
            df = freeze(target_encode_crossfit(rows, texts, target, list(keys) or [number], folds).drop(number), "crossfit")
        elif encoding == "onehot":
            for c in texts:
                add(fit_onehot(df, c, drop_first=False))
        else:
            add(_label_projection(df, texts))
    if polynomial_degree:
        add(fit_polynomial(df, polynomial_degree, target=target))
    if interactions:
        add(fit_interaction(df, target=target))
    numbers = [c for c in numeric_columns(df) if c != target]
    if scaling:
        add(fit_scaler(df, numbers, scaling))
    selected = numbers
    if selection:
        selected = [c for c in select_features(df, target, selection, max_features) if c != target]
    fitting = df.select(*[col(c) for c in [*[n for n in df.columns if n in selected], target]])
    return Features(steps, selected, target, originals, fitting)


def engineer_features(df: DataFrame, target: str | None = None, **options) -> tuple[DataFrame, Features]:
    """The engineered rows of ``df``, out of fold where their encoding knows the target, and the fitted features."""
    fitted = fit_features(df, target, **options)
    return fitted.fitting, fitted


