"""Estimators by name, with parameters in the names users of tabular libraries know.

Linear models and forests are Spark ML estimators; boosted trees are this library's (`boosting`), with the penalties,
minimum leaves, row and column shares and missing values that each name stands for. `cross_fit` trains linear and boosted models
and forests (`forest`) of all folds together by the same settings.
"""

from __future__ import annotations

import logging
from typing import Any

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.regression import LinearRegression, RandomForestRegressor

from foldsafe.errors import MetricError, TrainingError
from foldsafe.operators import forest
from foldsafe.operators.boosting import MOST_BINS, Settings
from foldsafe.operators.fitted import BoostedClassifier, BoostedRegressor

LABEL = "label"
FEATURES = "features"
TASKS = ("binary", "regression", "multiclass")

# Model names, their other spellings, and the defaults each name stands for.
ALIASES = {
    "logistic": "logistic",
    "ridge": "ridge",
    "rf": "rf",
    "random_forest": "rf",
    "randomforest": "rf",
    "gbc": "gbc",
    "gradient_boosting": "gbc",
    "hgb": "hgb",
    "histgb": "hgb",
    "hist_gradient_boosting": "hgb",
    "xgb": "xgb",
    "catboost": "catboost",
}
DEFAULTS: dict[str, dict[str, Any]] = {
    "logistic": {"max_iter": 1000, "C": 1.0},
    "ridge": {"alpha": 1.0},
    "rf": {"n_estimators": 300, "random_state": 42, "max_depth": 30, "max_features": "sqrt"},
    "gbc": {"n_estimators": 200, "learning_rate": 0.05, "max_depth": 3, "random_state": 42},
    "hgb": {
        "max_iter": 100,
        "learning_rate": 0.06,
        "max_depth": 3,
        "max_bins": 255,
        "l2_regularization": 0.0,
        "min_samples_leaf": 20,
        "random_state": 42,
    },
    "xgb": {
        "n_estimators": 400,
        "max_depth": 4,
        "learning_rate": 0.05,
        "subsample": 0.9,
        "colsample_bytree": 0.9,
        "reg_lambda": 1.0,
        "min_child_weight": 1.0,
        "random_state": 42,
    },
    "catboost": {"iterations": 800, "depth": 4, "learning_rate": 0.05, "l2_leaf_reg": 3.0, "random_seed": 42},
}
BOOSTED = ("gbc", "hgb", "xgb", "catboost")
LINEAR = ("logistic", "ridge")
# Names whose trees send missing values to a side of their own; the others get imputed ones.
NATIVE_BLANKS = ("hgb", "xgb", "catboost")
# Settings that steer threads or printing.
IGNORED = {
    "n_jobs",
    "verbose",
    "verbosity",
    "random_state",
    "eval_metric",
    "loss_function",
    "tree_method",
    "use_label_encoder",
    "solver",
}
_FOREST = {
    "n_estimators": "numTrees",
    "max_depth": "maxDepth",
    "max_bins": "maxBins",
    "random_state": "seed",
    "min_samples_leaf": "minInstancesPerNode",
    "max_features": "featureSubsetStrategy",
    "subsample": "subsamplingRate",
}
_BOOSTING = {
    "n_estimators": "rounds",
    "iterations": "rounds",
    "max_iter": "rounds",
    "max_depth": "depth",
    "depth": "depth",
    "learning_rate": "rate",
    "max_bins": "bins",
    "random_state": "seed",
    "random_seed": "seed",
    "subsample": "row_share",
    "colsample_bytree": "feature_share",
    "max_features": "feature_share",
    "min_samples_leaf": "least_rows",
    "min_child_weight": "least_weight",
    "l2_regularization": "penalty",
    "reg_lambda": "penalty",
    "l2_leaf_reg": "penalty",
}
# What a name stands for besides its parameters: splits judged by rows instead of curvature, one split per level, and
# scores that start at 0 for a binary task.
_FORMS: dict[str, dict[str, Any]] = {
    "gbc": {"by_rows": True},
    "hgb": {},
    "xgb": {},
    "catboost": {"symmetric": True},
}
_FOREST_MB = 1024
_AS_TEXT = {"featureSubsetStrategy"}

log = logging.getLogger(__name__)


def _translate(name: str, params: dict[str, Any], names: dict[str, str]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for key, value in params.items():
        if key in names:
            target = names[key]
            out[target] = str(value) if target in _AS_TEXT else value
        elif key in IGNORED:
            log.info("%s: setting %s has no effect here", name, key)
        else:
            raise TrainingError(f"{name} has no parameter {key!r}")
    return out


def canonical(name: str) -> str:
    key = ALIASES.get(name.lower())
    if key is None:
        raise TrainingError(f"unknown model {name!r}; known: {', '.join(sorted(set(ALIASES)))}")
    return key


def grown_together(name: str, params: dict[str, Any] | None = None) -> bool:
    """Whether a model is a forest whose bins have a code each."""
    merged = {**DEFAULTS[canonical(name)], **(params or {})}
    return canonical(name) == "rf" and merged.get("max_bins", 0) <= MOST_BINS


def boosting_settings(name: str, task: str, params: dict[str, Any] | None = None) -> Settings:
    """Settings of the booster for a model name."""
    key = canonical(name)
    known = _translate(name, {**DEFAULTS[key], **(params or {})}, _BOOSTING)
    from_prior = not (key == "catboost" and task == "binary")
    try:
        return Settings(**known, **_FORMS[key], from_prior=from_prior)
    except TypeError as error:
        raise TrainingError(f"{name}: {error}") from error


def forest_settings(name: str, task: str, params: dict[str, Any] | None = None) -> forest.Settings:
    """Settings of a forest grown for all folds together; what is not given is as in Spark ML's."""
    made = make(name, task, params)
    return forest.Settings(
        trees=made.getNumTrees(), depth=made.getMaxDepth(), bins=made.getMaxBins(), least_rows=made.getMinInstancesPerNode(),
        features=made.getFeatureSubsetStrategy(), row_rate=made.getSubsamplingRate(), seed=made.getSeed(),
    )


def linear_settings(name: str, task: str, params: dict[str, Any] | None = None) -> dict[str, Any]:
    """What a linear model is fitted with: strength of the penalty, and whether it has an intercept."""
    key = canonical(name)
    if key == "logistic" and task != "binary":
        raise TrainingError("logistic needs a binary task")
    names = {"C": "C", "alpha": "alpha", "max_iter": "max_iter", "tol": "tol", "fit_intercept": "fit_intercept"}
    own = ("C", "max_iter", "tol", "fit_intercept") if key == "logistic" else ("alpha", "max_iter", "fit_intercept")
    return _translate(name, {**DEFAULTS[key], **(params or {})}, {k: v for k, v in names.items() if k in own})


def make(
    name: str,
    task: str,
    params: dict[str, Any] | None = None,
    n_train: int = 1,
    label_deviation: float = 1.0,
) -> Estimator:
    """Estimator for a model name.

    The penalties of ``logistic`` (C) and ``ridge`` (alpha) are per data set, Spark's are per row;
    so they need the number of training rows, and ridge the labels' population deviation.
    """
    if task not in TASKS:
        raise TrainingError(f"unknown task {task!r}")
    if task == "multiclass":
        raise MetricError("multiclass tasks have no metric")
    key = canonical(name)
    merged = {**DEFAULTS[key], **(params or {})}
    columns = {"featuresCol": FEATURES, "labelCol": LABEL}
    if key == "logistic":
        if task != "binary":
            raise TrainingError("logistic needs a binary task")
        known = _translate(name, merged, {"C": "C", "max_iter": "maxIter", "tol": "tol", "fit_intercept": "fitIntercept"})
        penalty = 1.0 / (known.pop("C") * n_train)
        return LogisticRegression(
            **columns, **known, regParam=penalty, elasticNetParam=0.0, standardization=False
        )
    if key == "ridge":
        known = _translate(name, merged, {"alpha": "alpha", "max_iter": "maxIter", "fit_intercept": "fitIntercept"})
        penalty = known.pop("alpha") * label_deviation / n_train
        return LinearRegression(
            **columns,
            **known,
            regParam=penalty,
            elasticNetParam=0.0,
            standardization=False,
            solver="normal",
        )
    if key == "rf":
        kind = RandomForestClassifier if task == "binary" else RandomForestRegressor
        # Deep trees: nodes of a level that do not fit the memory for one pass cost another pass over the rows.
        return kind(**columns, **_translate(name, merged, _FOREST), maxMemoryInMB=_FOREST_MB, cacheNodeIds=True)
    kind = BoostedClassifier if task == "binary" else BoostedRegressor
    return kind(boosting_settings(name, task, params))
