"""Fitting, applying, saving and loading models."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.columns import col, double, is_text, literal, numeric_columns, require
from ..operators.encode import categories
from ..operators.knn import knn_join
from ..operators.ordered import row_numbers
from .catalogue import TrainingFacts, forest_settings, hyperparameters, is_classifier, spark_estimator
from .boosting import BoostedTrees, fit_boosted
from .boosting import settings_of as boosting_settings
from .forest import Forest, fit_forest
from .network import fit_network
from .network import settings_of as network_settings
from .optimise import minimise, summed_gradient, tube_loss

MAX_CLASSES = 1000
#: Types that learn where missing values go and score them.
BOOSTED = ("xgboost_classifier", "xgboost_regressor", "lightgbm_classifier", "lightgbm_regressor")


@dataclass
class FittedModel:
    """A trained model: ``stages`` turn feature columns into a prediction."""

    model_type: str
    features: list[str]
    target: str
    classes: list | None
    params: dict
    stages: PipelineModel | None = None
    reference: DataFrame | None = None  # nearest-neighbour models keep their training rows
    info: dict = field(default_factory=dict)

    @property
    def classification(self) -> bool:
        return self.classes is not None

    def transform(self, df: DataFrame, key: str | None = None) -> DataFrame:
        """Add ``prediction`` and, where the model has them, ``probability`` per class in class order.

        Every row is kept; a row with a missing feature has null results unless the model learnt what to do with it.
        """
        require(df, *self.features)
        if self.reference is not None:
            return self._neighbours(df, key)
        # rows with a missing feature stay; they are scored on zeros and lose the result again
        ready = df.withColumns({f"__f{i}": double(df, c) for i, c in enumerate(self.features)})
        if self.model_type in BOOSTED:
            ready = ready.withColumn("__whole", F.lit(True))
        else:
            ready = ready.withColumn("__whole", _complete(len(self.features)))
            ready = ready.withColumns({f"__f{i}": F.coalesce(f"__f{i}", F.lit(0.0)) for i in range(len(self.features))})
        scored = self.stages.transform(ready)
        value: Column = col("__prediction") if "__prediction" in scored.columns else col("prediction")
        extra = {}
        if self.classification:
            value = self._class_of(value)
            probability = _probability(scored)
            if probability is not None:
                extra["probability"] = F.when(col("__whole"), probability)
        value = F.when(col("__whole"), value)
        return scored.select(*[col(c) for c in df.columns], value.alias("prediction"), *[
            v.alias(k) for k, v in extra.items()
        ])

    def _class_of(self, index: Column) -> Column:
        names = F.expr(f"array({', '.join(literal(c) for c in self.classes)})")
        return F.get(names, index.cast("int"))

    def _neighbours(self, df: DataFrame, key: str | None) -> DataFrame:
        if key is None:
            raise ValueError("nearest-neighbour models need a unique whole-number key column")
        k = self.params["n_neighbors"]
        vector = F.array(*[double(df, c) for c in self.features])
        points = df.select(col(key), vector.alias("__v")).where(~F.exists("__v", lambda x: x.isNull()))
        near = knn_join(points, self.reference, key, "__id", "__v", k, carry="__y")
        weight = F.lit(1.0)
        if self.params["weights"] == "distance":  # neighbours at no distance outvote all others
            exact = F.min("distance").over(Window.partitionBy("query_id")) == 0
            weight = F.when(exact, (F.col("distance") == 0).cast("double")).otherwise(1 / F.col("distance"))
        near = near.withColumn("__w", weight)
        if self.classification:
            # k rows per query: the weight of each class, ties to the smallest class
            votes = near.groupBy("query_id", "__y").agg(F.sum("__w").alias("n"))
            best = votes.groupBy("query_id").agg(
                F.min_by("__y", F.struct((-F.col("n")).alias("n"), F.col("__y"))).alias("prediction")
            )
            best = best.withColumn("prediction", self._class_of(F.col("prediction")))
        else:
            best = near.groupBy("query_id").agg((F.sum(F.col("__y") * F.col("__w")) / F.sum("__w")).alias("prediction"))
        # predictions are as many as the rows: a plain join on the unique key
        return df.join(best.withColumnRenamed("query_id", "__q"), col(key) == F.col("__q"), "left").drop("__q")

    def save(self, path: str) -> None:
        """The stages (or reference rows) and a one-row JSON description, all in one folder."""
        if self.reference is not None:
            spark = self.reference.sparkSession
            self.reference.write.mode("overwrite").parquet(f"{path}/reference")
        else:
            spark = SparkSession.active()
            self.stages.write().overwrite().save(f"{path}/stages")
        text = json.dumps(
            {
                "model_type": self.model_type, "features": self.features, "target": self.target,
                "classes": self.classes, "params": self.params, "info": self.info,
                "is_classifier": self.classification,
            }
        )
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> FittedModel:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    about.pop("is_classifier")
    fitted = FittedModel(**about)
    if fitted.model_type.startswith("knn"):
        fitted.reference = spark.read.parquet(f"{path}/reference")
    else:
        fitted.stages = PipelineModel.load(f"{path}/stages")
    return fitted


def _probability(scored: DataFrame) -> Column | None:
    if "__probability" in scored.columns:
        return col("__probability")
    if "probability" in scored.columns:
        return vector_to_array(col("probability"))
    return None


def _complete(n: int) -> Column:
    present = F.lit(True)
    for i in range(n):
        present = present & col(f"__f{i}").isNotNull()
    return present


def feature_columns(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> list[str]:
    """Every column but the target; text must be encoded first."""
    names = [c for c in df.columns if c != target and c not in exclude]
    numbers = set(numeric_columns(df))
    wrong = [c for c in names if c not in numbers]
    if wrong:
        raise ValueError(f"encode these columns before training: {', '.join(wrong)}")
    if not names:
        raise ValueError("no feature columns")
    return names


def fit_model(
    df: DataFrame,
    target: str,
    model_type: str,
    params: dict | None = None,
    features: Sequence[str] | None = None,
    key: str | None = None,
) -> FittedModel:
    """Train one model type on all complete rows of ``df``."""
    require(df, target)
    p = hyperparameters(model_type, params)
    features = feature_columns(df, target) if features is None else list(features)
    require(df, *features)
    classes = None
    if is_classifier(model_type):
        classes = categories(df, target, MAX_CLASSES)
        if len(classes) < 2:
            raise ValueError("classification needs at least two classes")
        names = F.expr(f"array({', '.join(literal(c) for c in classes)})")
        place = F.array_position(names.cast(f"array<{df.schema[target].dataType.simpleString()}>"), col(target))
        label = F.when(place > 0, (place - 1).cast("double"))
    else:
        if is_text(df, target):
            raise ValueError("regression needs a numeric target")
        label = double(df, target)
    extra = [col(p["early_stopping"])] if isinstance(p.get("early_stopping"), str) else []
    complete = F.lit(True) if model_type in BOOSTED else _complete(len(features))
    rows = df.select(
        *([col(key)] if key else []), *[double(df, c).alias(f"__f{i}") for i, c in enumerate(features)],
        label.alias("label"), *extra,
    ).where(complete & F.col("label").isNotNull())
    model = FittedModel(model_type, features, target, classes, p)
    if model_type.startswith("knn"):
        model.reference = _reference_rows(rows, len(features), key)
        return model
    kept = rows.persist()
    rows = _spread(kept)
    try:
        fit = {
            "naive_bayes": _fit_bayes, "svc": _fit_kernel_classifier, "svr": _fit_kernel_regressor,
            "mlp_regressor": _fit_network, "mlp_classifier": _fit_network, **dict.fromkeys(BOOSTED, _fit_boosted),
            "random_forest_classifier": _fit_forest, "random_forest_regressor": _fit_forest,
        }.get(model_type, _fit_builtin)
        model.stages = fit(rows, model, len(features))
    finally:
        rows.unpersist()
        kept.unpersist()
    return model


def _spread(rows: DataFrame) -> DataFrame:
    """Use every core for the many passes of training when the persisted input has fewer partitions than that."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores).persist() if rows.rdd.getNumPartitions() < cores else rows


def _facts(rows: DataFrame, model: FittedModel, d: int) -> TrainingFacts:
    n, std = rows.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
    if not n:
        raise ValueError("no complete rows to train on")
    return TrainingFacts(n, d, len(model.classes or ()), std or 1.0)


def _assembler(d: int) -> VectorAssembler:
    return VectorAssembler(inputCols=[f"__f{i}" for i in range(d)], outputCol="features")


def _fit_builtin(rows: DataFrame, model: FittedModel, d: int) -> PipelineModel:
    estimator = spark_estimator(model.model_type, model.params, _facts(rows, model, d))
    return Pipeline(stages=[_assembler(d), estimator]).fit(rows)


def _reference_rows(rows: DataFrame, d: int, key: str | None) -> DataFrame:
    vector = F.array(*[F.col(f"__f{i}") for i in range(d)]).alias("__v")
    if key:
        return rows.select(col(key).cast("bigint").alias("__id"), vector, F.col("label").alias("__y"))
    # without a key, rows are numbered along their values
    order = [F.col(f"__f{i}") for i in range(d)] + [F.col("label")]
    return row_numbers(rows, order, "__id").select("__id", vector, F.col("label").alias("__y"))


def _sql_stages(*statements: str) -> PipelineModel:
    return PipelineModel(stages=[SQLTransformer(statement=s) for s in statements])


# --- Gaussian naive Bayes: per-class moments become one SQL projection ---------------------------


def bayes_moments(rows: DataFrame, d: int) -> list:
    aggs = [F.count(F.lit(1)).alias("n")]
    for i in range(d):
        aggs += [F.avg(f"__f{i}").alias(f"m{i}"), F.var_pop(f"__f{i}").alias(f"v{i}")]
    return rows.groupBy("label").agg(*aggs).orderBy("label").collect()


def _fit_bayes(rows: DataFrame, model: FittedModel, d: int) -> PipelineModel:
    spread = rows.agg(*[F.var_pop(f"__f{i}") for i in range(d)]).first()
    epsilon = model.params["var_smoothing"] * max(spread) or 1e-12
    classes = bayes_moments(rows, d)
    total = sum(r["n"] for r in classes)
    scores = []
    for r in classes:
        base, terms = float(np.log(r["n"] / total)), []
        for i in range(d):
            variance = r[f"v{i}"] + epsilon
            base -= 0.5 * float(np.log(2 * np.pi * variance))
            gap = f"(__f{i} - {literal(float(r[f'm{i}']))})"
            terms.append(f"{gap} * {gap} / {literal(float(2 * variance))}")
        scores.append(f"{literal(base)} - ({' + '.join(terms)})")
    return _sql_stages(
        f"SELECT *, array({', '.join(scores)}) AS __scores FROM __THIS__",
        "SELECT *, transform(__scores, s -> exp(s - array_max(__scores))) AS __weights FROM __THIS__",
        "SELECT *, transform(__weights, w -> w / aggregate(__weights, 0D, (a, b) -> a + b)) AS __probability, "
        "CAST(array_position(__scores, array_max(__scores)) - 1 AS DOUBLE) AS __prediction FROM __THIS__",
    )


# --- radial kernels by random Fourier features ----------------------------------------------------


def _kernel_columns(rows: DataFrame, model: FittedModel, d: int) -> tuple[str, int, Callable[[np.ndarray], np.ndarray]]:
    """SQL adding ``__k0..``: cos(w.x + b) features that approximate a Gaussian kernel; their number; the same on arrays."""
    p = model.params
    if p["kernel"] == "linear":
        return "SELECT *, " + ", ".join(f"__f{i} AS __k{i}" for i in range(d)) + " FROM __THIS__", d, lambda x: x
    gamma = p["gamma"]
    if gamma in ("scale", "auto"):
        cells = rows.select(F.explode(F.array(*[F.col(f"__f{i}") for i in range(d)])).alias("x"))
        variance = cells.agg(F.var_pop("x")).first()[0] if gamma == "scale" else 1.0
        gamma = 1.0 / (d * variance) if variance else 1.0
    random = np.random.default_rng(p["random_state"])
    size = p["n_components"]
    w = random.normal(0.0, np.sqrt(2.0 * gamma), (size, d))
    b = random.uniform(0.0, 2 * np.pi, size)
    height = literal(float(np.sqrt(2.0 / size)))
    columns = []
    for j in range(size):
        inner = " + ".join(f"{literal(float(w[j, i]))} * __f{i}" for i in range(d))
        columns.append(f"{height} * cos({inner} + {literal(float(b[j]))}) AS __k{j}")

    def expand(x: np.ndarray) -> np.ndarray:
        inner = sum(x[:, i : i + 1] * w[:, i] for i in range(d))  # in the order of the SQL
        return np.sqrt(2.0 / size) * np.cos(inner + b)

    return f"SELECT *, {', '.join(columns)} FROM __THIS__", size, expand


def _fit_kernel_classifier(rows: DataFrame, model: FittedModel, d: int) -> PipelineModel:
    if model.params["kernel"] == "linear":
        return _fit_builtin(rows, model, d)
    statement, size, _ = _kernel_columns(rows, model, d)
    stages = [
        SQLTransformer(statement=statement),
        VectorAssembler(inputCols=[f"__k{j}" for j in range(size)], outputCol="features"),
        spark_estimator("svc", model.params, _facts(rows, model, d)),
    ]
    return Pipeline(stages=stages).fit(rows)


def _fit_kernel_regressor(rows: DataFrame, model: FittedModel, d: int) -> PipelineModel:
    statement, size, features = _kernel_columns(rows, model, d)
    expand = SQLTransformer(statement=statement)
    # the rows are kept as they are: every pass expands a batch at a time
    data = rows.select(F.array(*[F.col(f"__f{i}") for i in range(d)]).alias("x"), F.col("label").alias("y"))
    n, mean = data.agg(F.count(F.lit(1)), F.avg("y")).first()
    tasks = data.rdd.getNumPartitions()
    tube, c = tube_loss(model.params["epsilon"]), model.params["C"]

    def loss(theta: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        return tube(theta, features(x), y)

    def evaluate(theta: np.ndarray) -> tuple[float, np.ndarray]:
        # C * sum(loss) + |w|^2 / 2, both divided by C * n to keep the numbers near one
        value, gradient = summed_gradient(data, loss, theta, tasks)
        weights = np.append(theta[:-1], 0.0)
        return value / n + weights @ weights / (2 * c * n), gradient / n + weights / (c * n)

    theta = minimise(evaluate, np.append(np.zeros(size), mean), model.params["max_iter"])
    total = " + ".join(f"{literal(float(t))} * __k{j}" for j, t in enumerate(theta[:-1]))
    final = SQLTransformer(
        statement=f"SELECT *, {total} + {literal(float(theta[-1]))} AS __prediction FROM __THIS__"
    )
    return PipelineModel(stages=[expand, final])


# --- networks and second-order boosting -----------------------------------------------------------


def _fit_network(rows: DataFrame, model: FittedModel, d: int) -> PipelineModel:
    network, curve = fit_network(rows, d, len(model.classes or ()), network_settings(model.params))
    model.info["epochs"] = len(curve)
    return PipelineModel(stages=[network])


def _fit_boosted(rows: DataFrame, model: FittedModel, d: int) -> PipelineModel:
    settings = boosting_settings(model.params, model.model_type.startswith("lightgbm"))
    trees = fit_boosted(rows, d, len(model.classes or ()), settings, model.params["early_stopping"])
    model.info["rounds"] = len(trees.about()["rounds"])
    return PipelineModel(stages=[trees])


# --- forests --------------------------------------------------------------------------------------


def _fit_forest(rows: DataFrame, model: FittedModel, d: int) -> PipelineModel:
    forest = fit_forest(rows, d, len(model.classes or ()), forest_settings(model.params, d, model.classification))
    return PipelineModel(stages=[forest]) if forest is not None else _fit_builtin(rows, model, d)


# --- importance -----------------------------------------------------------------------------------


def feature_importance(model: FittedModel, spark: SparkSession) -> DataFrame:
    """(feature, importance): tree importances, else mean absolute coefficient over the classes."""
    stage: Transformer | None = model.stages.stages[-1] if model.stages else None
    if isinstance(stage, BoostedTrees):  # by mean gain of a split, or by splits, in the manner of each library
        about = stage.about()
        gains, splits = np.array(about["gains"]), np.array(about["splits"], dtype=float)
        values = splits if model.model_type.startswith("lightgbm") else np.divide(gains, splits, out=np.zeros_like(gains), where=splits > 0)
        values = values / values.sum() if values.sum() and not model.model_type.startswith("lightgbm") else values
    elif isinstance(stage, Forest):
        values = np.array(stage.about()["importance"])
    elif hasattr(stage, "featureImportances"):
        values = stage.featureImportances.toArray()
    elif hasattr(stage, "coefficientMatrix") and model.model_type != "svc":
        values = np.abs(stage.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(stage, "coefficients") and model.model_type != "svc":
        values = np.abs(stage.coefficients.toArray())
    else:
        raise ValueError(f"{model.model_type} does not provide feature importance")
    rows = list(zip(model.features, (float(v) for v in values)))
    return spark.createDataFrame(rows, "feature string, importance double")


def top_importance(importance: DataFrame, k: int = 20) -> DataFrame:
    return importance.orderBy(F.desc("importance"), F.asc("feature")).limit(k)


def describe_model(model: FittedModel) -> dict:
    about = asdict(FittedModel(model.model_type, model.features, model.target, model.classes, model.params))
    return {k: v for k, v in about.items() if k not in ("stages", "reference", "info")}
