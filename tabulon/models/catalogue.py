"""The model types, their defaults and the Spark estimators behind them."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Estimator, classification as mc, regression as mr

from .forest import ForestSettings

CLASSIFIERS = (
    "logistic_regression", "random_forest_classifier", "decision_tree_classifier", "svc", "knn_classifier",
    "naive_bayes", "gradient_boosting_classifier", "mlp_classifier", "xgboost_classifier", "lightgbm_classifier",
)
REGRESSORS = (
    "linear_regression", "random_forest_regressor", "decision_tree_regressor", "svr", "knn_regressor", "ridge",
    "lasso", "elastic_net", "mlp_regressor", "xgboost_regressor", "lightgbm_regressor",
)

_FOREST = {"n_estimators": 100, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1, "random_state": 42}
_TREE = {"max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1, "random_state": 42}
_NEIGHBOURS = {"n_neighbors": 5, "weights": "uniform", "algorithm": "auto"}
_NETWORK = {
    "hidden_layer_sizes": (100,), "activation": "relu", "solver": "adam", "alpha": 0.0001, "learning_rate": "constant",
    "max_iter": 200, "random_state": 42,
}
_XGBOOST = {
    "n_estimators": 100, "max_depth": 6, "learning_rate": 0.1, "subsample": 1.0, "colsample_bytree": 1.0,
    "random_state": 42,
}
_LIGHTGBM = {
    "n_estimators": 100, "max_depth": -1, "learning_rate": 0.1, "num_leaves": 31, "subsample": 1.0,
    "colsample_bytree": 1.0, "random_state": 42,
}

#: default hyperparameters (fixed values); a caller's entries replace them key by key
DEFAULTS: dict[str, dict] = {
    "logistic_regression": {"C": 1.0, "max_iter": 1000, "solver": "lbfgs", "random_state": 42},
    "random_forest_classifier": _FOREST,
    "decision_tree_classifier": _TREE,
    "svc": {"C": 1.0, "kernel": "rbf", "gamma": "scale", "random_state": 42},
    "knn_classifier": _NEIGHBOURS,
    "naive_bayes": {"var_smoothing": 1e-9},
    "gradient_boosting_classifier": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3, "random_state": 42},
    "mlp_classifier": _NETWORK,
    "xgboost_classifier": _XGBOOST,
    "lightgbm_classifier": _LIGHTGBM,
    "linear_regression": {},
    "random_forest_regressor": _FOREST,
    "decision_tree_regressor": _TREE,
    "svr": {"C": 1.0, "kernel": "rbf", "gamma": "scale"},
    "knn_regressor": _NEIGHBOURS,
    "ridge": {"alpha": 1.0, "random_state": 42},
    "lasso": {"alpha": 1.0, "random_state": 42},
    "elastic_net": {"alpha": 1.0, "l1_ratio": 0.5, "random_state": 42},
    "mlp_regressor": _NETWORK,
    "xgboost_regressor": _XGBOOST,
    "lightgbm_regressor": _LIGHTGBM,
}

_LINE = {"fit_intercept": True}
_KERNEL = {"n_components": 100, "max_iter": 100}
_SECOND_ORDER = {"reg_lambda": 1.0, "gamma": 0.0, "min_child_weight": 1.0, "early_stopping": None, "patience": 10}
_BEST_FIRST = {"reg_lambda": 0.0, "min_child_weight": 0.001, "min_child_samples": 20, "early_stopping": None, "patience": 10}
_STOPPING = {
    "learning_rate_init": 0.001, "batch_size": "auto", "tol": 0.0001, "early_stopping": False, "validation_fraction": 0.1, "n_iter_no_change": 10,
}
#: further keys that a type knows, and their values when not given
FURTHER: dict[str, dict] = {
    "logistic_regression": {**_LINE, "penalty": "l2", "l1_ratio": 0.0}, "svc": _KERNEL, "svr": {**_KERNEL, "epsilon": 0.1, "random_state": 42},
    "linear_regression": _LINE, "ridge": _LINE, "lasso": {**_LINE, "max_iter": 1000}, "elastic_net": {**_LINE, "max_iter": 1000},
    "gradient_boosting_classifier": {"subsample": 1.0, "min_samples_split": 2, "min_samples_leaf": 1, "early_stopping": None},
    "mlp_classifier": _STOPPING, "mlp_regressor": _STOPPING,
    "xgboost_classifier": _SECOND_ORDER, "xgboost_regressor": _SECOND_ORDER, "lightgbm_classifier": _BEST_FIRST, "lightgbm_regressor": _BEST_FIRST,
}
#: values that a key may take; others are refused with a reason
_CHOICES: dict[str, tuple[tuple, str]] = {
    "solver": (("lbfgs", "liblinear", "newton-cg", "newton-cholesky", "sag", "saga", "adam", "sgd"), "no such solver"),
    "penalty": (("l2", "l1", "elasticnet", None), "no such penalty"),
    "kernel": (("rbf", "linear"), "random features approximate the radial kernel only"),
    "weights": (("uniform", "distance"), "neighbours vote equally or by inverse distance"),
    "algorithm": (("auto", "brute", "kd_tree", "ball_tree"), "the search is exact whatever its name"),
    "activation": (("relu", "tanh", "logistic", "identity"), "no such activation"),
}
_NETWORK_SOLVERS = ("adam", "sgd", "lbfgs")

#: model families of the offline chain and their defaults (fixed values)
FAMILIES: dict[str, dict] = {
    "random_forest": {"n_estimators": 100, "max_depth": 10, "min_samples_split": 5, "min_samples_leaf": 2, "random_state": 42},
    "xgboost": {
        "n_estimators": 100, "max_depth": 6, "learning_rate": 0.1, "subsample": 0.8, "colsample_bytree": 0.8,
        "random_state": 42,
    },
    "lightgbm": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1, "num_leaves": 31, "random_state": 42},
    "neural_network": {
        "hidden_layers": (128, 64, 32), "activation": "relu", "dropout_rate": 0.3, "learning_rate": 0.001, "batch_size": 32, "epochs": 100,
        "early_stopping_patience": 10, "random_state": 42,
    },
}
_FAMILY_STEM = {"random_forest": "random_forest", "xgboost": "xgboost", "lightgbm": "lightgbm", "neural_network": "mlp"}
#: what the network family calls a model's hyperparameters; its dropout rate is the weight penalty
_NETWORK_NAMES = {
    "hidden_layers": "hidden_layer_sizes", "dropout_rate": "alpha", "learning_rate": "learning_rate_init", "epochs": "max_iter",
    "early_stopping_patience": "n_iter_no_change",
}

MAX_TREE_DEPTH = 30
PARALLEL_CLASSES = 4  # one-against-rest fits that run at a time


@dataclass(frozen=True)
class TrainingFacts:
    """What the estimators need to know about the training rows."""

    n_rows: int
    n_features: int
    n_classes: int = 0
    label_std: float = 1.0


def available_models() -> dict[str, list[str]]:
    return {"classification": list(CLASSIFIERS), "regression": list(REGRESSORS)}


def is_classifier(model_type: str) -> bool:
    if model_type not in DEFAULTS:
        raise ValueError(f"unsupported model type: {model_type}")
    return model_type in CLASSIFIERS


def hyperparameters(model_type: str, overrides: dict | None = None) -> dict:
    """All settings of a model type; a key it doesn't know, or a value it can't honour, is an error with the reason."""
    is_classifier(model_type)
    known = {**DEFAULTS[model_type], **FURTHER.get(model_type, {})}
    merged = {**known, **(overrides or {})}
    if unknown := set(merged) - set(known):
        raise ValueError(f"unknown hyperparameter(s) for {model_type}: {', '.join(sorted(unknown))}")
    for key, (values, reason) in _CHOICES.items():
        if key in merged and merged[key] not in values:
            raise ValueError(f"{key}={merged[key]!r} is not supported: {reason}")
    network = "hidden_layer_sizes" in merged
    if "solver" in merged and (merged["solver"] in _NETWORK_SOLVERS) != network and merged["solver"] != "lbfgs":
        raise ValueError(f"solver={merged['solver']!r} is not supported: {model_type} has no such solver")
    if network and merged["learning_rate"] != "constant":
        raise ValueError(f"learning_rate={merged['learning_rate']!r} is not supported: steps keep their rate; set learning_rate_init")
    return merged


def family_model(family: str, task: str, overrides: dict | None = None) -> tuple[str, dict]:
    """The model type and hyperparameters of an offline-chain family for a task; the family's own key names are understood."""
    if family not in FAMILIES:
        raise ValueError(f"unknown model family: {family}")
    suffix = "classifier" if task == "classification" else "regressor"
    settings = {**FAMILIES[family], **(overrides or {})}
    if family == "neural_network":
        settings = {"early_stopping": True, **{_NETWORK_NAMES.get(k, k): v for k, v in settings.items()}}
    return f"{_FAMILY_STEM[family]}_{suffix}", settings


def _depth(p: dict) -> int:
    depth = p.get("max_depth")
    if depth is None:
        return MAX_TREE_DEPTH
    if depth > MAX_TREE_DEPTH:
        raise ValueError(f"max_depth goes up to {MAX_TREE_DEPTH}, which is also what no limit means")
    return int(depth)


def _least_rows(p: dict) -> int:
    """Rows of a leaf: a node of fewer than min_samples_split rows isn't split if each half must hold half of them."""
    return max(p["min_samples_leaf"], math.ceil(p["min_samples_split"] / 2))


def _boosting(p: dict) -> dict:
    settings = {
        "maxIter": p["n_estimators"], "maxDepth": _depth(p), "stepSize": p["learning_rate"], "subsamplingRate": p["subsample"],
        "seed": p["random_state"], "minInstancesPerNode": _least_rows(p),
    }
    if p["early_stopping"]:
        settings["validationIndicatorCol"] = p["early_stopping"]
    return settings


def _forest(p: dict, subset: str) -> dict:
    return {
        "numTrees": p["n_estimators"], "maxDepth": _depth(p), "minInstancesPerNode": _least_rows(p),
        "seed": p["random_state"], "featureSubsetStrategy": subset,
    }


def forest_settings(p: dict, d: int, classification: bool) -> ForestSettings:
    """The same forest as :func:`spark_estimator`'s, grown from cells."""
    return ForestSettings(p["n_estimators"], _depth(p), _least_rows(p), math.ceil(math.sqrt(d)) if classification else d, p["random_state"])


def _tree(p: dict) -> dict:
    return {"maxDepth": _depth(p), "minInstancesPerNode": _least_rows(p), "seed": p["random_state"]}


def spark_estimator(model_type: str, p: dict, facts: TrainingFacts) -> Estimator:
    """The pyspark.ml estimator of a type that has one; columns ``features`` and ``label``."""
    if model_type == "logistic_regression":
        mixing = {"l2": 0.0, "l1": 1.0, "elasticnet": p["l1_ratio"], None: 0.0}[p["penalty"]]
        return mc.LogisticRegression(
            regParam=1.0 / (p["C"] * facts.n_rows) if p["penalty"] else 0.0, elasticNetParam=mixing, standardization=False, maxIter=p["max_iter"],
            fitIntercept=p["fit_intercept"],
        )
    if model_type == "random_forest_classifier":
        return mc.RandomForestClassifier(**_forest(p, "sqrt"))
    if model_type == "decision_tree_classifier":
        return mc.DecisionTreeClassifier(**_tree(p))
    if model_type == "svc":
        machine = mc.LinearSVC(regParam=1.0 / (p["C"] * facts.n_rows), maxIter=p["max_iter"], standardization=False)
        return machine if facts.n_classes <= 2 else mc.OneVsRest(classifier=machine, parallelism=PARALLEL_CLASSES)
    if model_type == "gradient_boosting_classifier":
        boosting = mc.GBTClassifier(**_boosting(p))
        return boosting if facts.n_classes <= 2 else mc.OneVsRest(classifier=boosting, parallelism=PARALLEL_CLASSES)
    if model_type == "linear_regression":
        return mr.LinearRegression(regParam=0.0, solver="normal", fitIntercept=p["fit_intercept"])
    if model_type == "random_forest_regressor":
        return mr.RandomForestRegressor(**_forest(p, "all"))
    if model_type == "decision_tree_regressor":
        return mr.DecisionTreeRegressor(**_tree(p))
    # Spark divides squared error by 2n and rescales by the label's spread; undo both
    spread = facts.label_std or 1.0
    if model_type == "ridge":
        reg, ratio = p["alpha"] * spread / facts.n_rows, 0.0
    elif model_type == "lasso":
        reg, ratio = p["alpha"], 1.0
    elif model_type == "elastic_net":
        l1 = p["alpha"] * p["l1_ratio"]
        reg = l1 + p["alpha"] * (1 - p["l1_ratio"]) * spread
        ratio = l1 / reg if reg else 0.0
    else:
        raise ValueError(f"{model_type} has no built-in estimator")
    return mr.LinearRegression(regParam=reg, elasticNetParam=ratio, standardization=False, maxIter=p.get("max_iter", 1000), tol=1e-10, fitIntercept=p["fit_intercept"])
