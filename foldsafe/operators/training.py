"""Cross-fit: train on the other folds, score the held-out one, compare models, keep every fold model."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsafe.config import CVConfig, FeaturesConfig, ModelSpec
from foldsafe.errors import InferenceError, TrainingError
from foldsafe.functions import snapshot
from foldsafe.operators import boosting, forest, linear, loo, metrics, models, preprocess, scoring, splits
from foldsafe.operators.contracts import require_columns, require_target
from foldsafe.operators.fitted import BoostedModel, ForestModel, LinearModel
from foldsafe.operators.small import table
from foldsafe.operators.threads import in_threads
from foldsafe.sources import runs as run_tables
from foldsafe.sources.scratch import written

# Saving or loading a model is many small files: a few at a time.
_FILE_THREADS = 4

log = logging.getLogger(__name__)


@dataclass
class Run:
    """What a cross-fit leaves behind. ``oof`` holds all models, ``models`` every fold model."""

    run_id: str
    id_col: str
    target: str
    task: str
    metric: metrics.Metric
    best: str
    params: dict[str, dict]
    scores: dict[str, list[float | None]]
    oof: DataFrame
    models: dict[str, list[PipelineModel]]
    features: FeaturesConfig = field(default_factory=FeaturesConfig)
    cv: CVConfig = field(default_factory=CVConfig)

    @property
    def fold_models(self) -> list[PipelineModel]:
        return self.models[self.best]

    def score_table(self) -> DataFrame:
        rows = [(m, i, s) for m, scores in self.scores.items() for i, s in enumerate(scores)]
        return table(self.oof.sparkSession, "model string, fold int, score double", rows)

    def best_oof(self) -> DataFrame:
        return self.oof.filter(F.col("model") == self.best)

    def summary(self) -> DataFrame:
        """One row per run: the report of the best model."""
        summed = metrics.fold_summary(self.score_table().filter(F.col("model") == self.best))
        return summed.select(
            F.lit(self.run_id).alias("run_id"),
            "model",
            F.lit(self.metric.name).alias("metric"),
            F.lit(self.metric.direction.value).alias("direction"),
            "fold_scores",
            "score_mean",
            "score_std",
            F.array(*[F.lit(f"fold={i}") for i in range(len(self.fold_models))]).alias("pipelines"),
            F.lit(json.dumps(self.params[self.best])).alias("params"),
            F.lit(json.dumps(self.features.flags())).alias("features_cfg"),
            F.lit(json.dumps(vars(self.cv))).alias("cv_cfg"),
            F.current_timestamp().alias("saved_at"),
        )

    def save(self, path: str) -> None:
        """Out-of-fold rows, summary and fold models below ``path``; other runs stay untouched."""
        run_tables.write_oof(self.oof, f"{path}/oof")
        run_tables.write_documents(self.summary(), f"{path}/cv_summary")

        def save(item: tuple[str, int, PipelineModel]) -> None:
            name, fold, model = item
            model.write().overwrite().save(_model_path(path, self.run_id, name, fold))

        every = [(n, i, m) for n, fitted in self.models.items() for i, m in enumerate(fitted)]
        in_threads(self.oof.sparkSession, save, every, _FILE_THREADS)


def _python_value(text: Column) -> Column:
    """JSON scalars in the spelling of the report's settings."""
    named = F.when(text == "true", "True").when(text == "false", "False").when(text.isNull(), "None")
    return named.otherwise(text)


def _short(number: Column) -> Column:
    """A number to five places, without trailing zeros but with one digit after the point."""
    whole = F.round(number, 5).cast("decimal(30,5)").cast("string")
    shown = F.regexp_replace(F.regexp_replace(whole, "0+$", ""), r"\.$", ".0")
    return F.when(F.isnan(number), "nan").otherwise(F.coalesce(shown, F.lit("None")))


def _items(document: Column, line: Callable[[Column, Column], Column]) -> Column:
    """One line per setting of a JSON object, in its order; null for anything else."""
    entries = F.map_entries(F.from_json(snapshot.json_object(document), "map<string,string>"))
    return F.array_join(F.transform(entries, lambda e: line(e["key"], _python_value(e["value"]))), "\n")


def run_report(summaries: DataFrame) -> DataFrame:
    """``(run_id, report)``: one Markdown document per run, made of its saved summary.

    Settings that were not saved leave their part empty; folds without a score show as None.
    """
    # Headings and labels of a run's report.
    scores = F.array_join(F.transform("fold_scores", _short), ", ")

    def setting(key: Column, value: Column) -> Column:
        return F.concat(F.lit("- "), key, F.lit(": "), value)

    def snapshot_line(key: Column, value: Column) -> Column:
        return F.concat(key, F.lit(": "), value)

    blank = F.lit("")
    text = F.concat_ws(
        "\n",
        F.lit("# Model Training Report"),
        blank,
        F.concat(F.lit("**Run Directory:** "), F.col("run_id")),
        blank,
        F.lit("## Best Model"),
        F.concat(F.lit("- Name: `"), F.coalesce("model", F.lit("None")), F.lit("`")),
        F.concat(F.lit("- Parameters: `"), F.coalesce("params", F.lit("{}")), F.lit("`")),
        blank,
        F.lit("## Cross-Validation Scores"),
        F.concat(F.lit("- Fold scores: ["), F.coalesce(scores, blank), F.lit("]")),
        F.concat(F.lit("- Mean CV score: "), _short(F.col("score_mean"))),
        blank,
        F.lit("## Features Used"),
        F.nullif(_items(F.col("features_cfg"), setting), blank),
        blank,
        F.lit("## Config Snapshot"),
        F.lit("### cv"),
        F.nullif(_items(F.col("cv_cfg"), snapshot_line), blank),
    )
    return summaries.select("run_id", text.alias("report"))


def _model_path(path: str, run_id: str, model: str, fold: int) -> str:
    return f"{path}/models/run_id={run_id}/model={model}/fold={fold}"


def load_fold_models(spark: SparkSession, path: str, run_id: str | None = None) -> list[PipelineModel]:
    """Fold models of the best model of a run, of the latest run unless one is named."""
    found = run_tables.last_saved(
        run_tables.read_documents(spark, f"{path}/cv_summary", run_tables.SUMMARY_SCHEMA)
    )
    run_id = run_id or run_tables.latest_id(found)
    row = found.filter(F.col("run_id") == run_id).first()
    if row is None:
        raise InferenceError(f"run {run_id} has no summary")
    if not row["pipelines"]:
        raise InferenceError(f"run {run_id} has no fold models")
    paths = [_model_path(path, run_id, row["model"], i) for i in range(len(row["pipelines"]))]
    return in_threads(spark, PipelineModel.load, paths, _FILE_THREADS)


def _training_labels(folded: DataFrame, n_splits: int, scheme: str) -> dict[int, tuple[int, float]]:
    """Rows and population deviation of the labels each holdout is trained on, from one pass."""
    rows = loo.numeric_moments(folded, [models.LABEL], n_splits, scheme).collect()
    return {r["holdout"]: (r["n"], (r["m2"] / r["n"]) ** 0.5 if r["n"] else 0.0) for r in rows}


def _fit_fold(
    folded: DataFrame,
    holdout: int,
    prep: PipelineModel,
    specs: dict[str, ModelSpec],
    task: str,
    scheme: str,
    labels: tuple[int, float],
) -> dict[str, PipelineModel]:
    train = folded.filter(splits.trains_on(scheme, F.col(splits.FOLD), holdout))
    ready = prep.transform(train).select(models.LABEL, models.FEATURES)
    # Every fit reads the vectors many times; all models of a fold share one copy.
    ready = ready.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = {}
        for name, spec in specs.items():
            estimator = models.make(spec.name, task, spec.params, *labels)
            fitted[name] = PipelineModel([*prep.stages, estimator.fit(ready)])
        return fitted
    finally:
        ready.unpersist()


def _lanes(folded: DataFrame, preps: list[PipelineModel], scheme: str, id_col: str) -> DataFrame:
    """The training rows of every holdout under its own pipeline, one below the other."""
    parts = []
    for holdout, prep in enumerate(preps):
        train = folded.filter(splits.trains_on(scheme, F.col(splits.FOLD), holdout))
        found = preprocess.direct(prep.stages, train)
        ready, vector = found or (prep.transform(train), vector_to_array(models.FEATURES))
        parts.append(ready.select(
            F.lit(holdout).alias("lane"), F.xxhash64(id_col).alias("key"), F.col(models.LABEL).alias("label"),
            vector.alias("features"),
        ))
    return reduce(DataFrame.unionByName, parts)


def _fit_together(
    folded: DataFrame,
    preps: list[PipelineModel],
    specs: dict[str, ModelSpec],
    task: str,
    scheme: str,
    id_col: str,
) -> dict[str, list[PipelineModel]]:
    """The models that are trained for all holdouts at once: boosted trees and, of few features, forests and linear ones."""
    made: dict[str, list[PipelineModel]] = {}

    def keep(name: str, used: list[PipelineModel], found: dict[int, Transformer]) -> None:
        missing = [h for h in range(len(preps)) if h not in found]
        if missing:
            raise TrainingError(f"folds without training rows: {missing}")
        made[name] = [PipelineModel([*prep.stages, found[h]]) for h, prep in enumerate(used)]

    straight = {n: s for n, s in specs.items() if models.canonical(s.name) in models.LINEAR}
    if straight and max(map(preprocess.width, preps)) <= linear.MOST_FEATURES:
        with linear.Lanes(_lanes(folded, preps, scheme, id_col)) as lanes:
            for name, spec in straight.items():
                own = models.linear_settings(spec.name, task, spec.params)
                intercept = own.get("fit_intercept", True)
                if models.canonical(spec.name) == "ridge":
                    found = linear.ridge(lanes, own["alpha"], intercept)
                else:
                    found = linear.logistic(lanes, own["C"], intercept, own["max_iter"], min(own.get("tol", 1e-10), 1e-8))
                keep(name, preps, {h: LinearModel.make(m.coefficients, m.intercept, task) for h, m in found.items()})
    for name, spec in specs.items():
        key = models.canonical(spec.name)
        if key in models.BOOSTED:
            used = [preprocess.with_blanks(p) for p in preps] if key in models.NATIVE_BLANKS else preps
            settings = models.boosting_settings(spec.name, task, spec.params)
            found = boosting.fit(_lanes(folded, used, scheme, id_col), settings, task)
            keep(name, used, {h: BoostedModel.make(e) for h, e in found.items()})
        elif models.grown_together(spec.name, spec.params) and max(map(preprocess.width, preps)) <= linear.MOST_FEATURES:
            grown = forest.fit(_lanes(folded, preps, scheme, id_col), models.forest_settings(spec.name, task, spec.params), task)
            keep(name, preps, {h: ForestModel.make(f) for h, f in grown.items()})
    return made


def _score_fold(
    folded: DataFrame, holdout: int, model: Transformer, name: str, id_col: str, task: str
) -> DataFrame:
    held_out = folded.filter(F.col(splits.FOLD) == holdout)
    return scoring.fold_average([model], held_out, task).select(
        id_col,
        splits.FOLD,
        F.lit(name).alias("model"),
        models.LABEL,
        F.col("p").alias("oof"),
    )


def cross_fit(
    df: DataFrame,
    cv: CVConfig,
    features: FeaturesConfig,
    specs: Sequence[ModelSpec],
    *,
    id_col: str,
    target: str,
    task: str = "binary",
    metric_name: str = "",
    run_id: str = "run",
    parallelism: int = 2,
    partitions: int | None = None,
) -> Run:
    """Fit every model on every fold's training rows and score the rows it has not seen.

    Preprocessing is learnt for all folds in a few shared passes. Boosted trees, forests and linear models (the latter two of up to
    `linear.MOST_FEATURES` features) are trained for all folds in the same jobs. Of other models ``parallelism``
    folds are trained at once; each holds one persisted copy of its training vectors. ``partitions`` deals the rows
    out evenly first: worth one shuffle if the table comes in few or uneven files, because training
    passes over it many times.
    """
    require_target(df, target)
    require_columns(df, [id_col], "training table")
    if not specs:
        raise TrainingError("no models are configured")
    metric = metrics.get(task, metric_name)
    named = {spec.name: spec for spec in specs}
    if len(named) != len(specs):
        raise TrainingError("model names must differ")
    for spec in specs:
        models.make(spec.name, task, spec.params)

    labelled = df.withColumn(models.LABEL, F.col(target).cast("double"))
    # Folds are a function of ids alone, so a lost executor re-computes the same rows.
    folded = splits.assign(labelled, cv, id_col, target)
    if partitions is not None:
        folded = folded.repartition(partitions, id_col)
    folded = folded.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        exclude = [id_col, target, models.LABEL]
        preps = preprocess.learn(folded, features, cv.n_splits, cv.scheme, exclude)
        together = _fit_together(folded, preps, named, task, cv.scheme, id_col)
        apart = {n: s for n, s in named.items() if n not in together}
        fitted = dict(together)
        if apart:
            labels = _training_labels(folded, cv.n_splits, cv.scheme)

            def fit(holdout: int) -> dict[str, PipelineModel]:
                return _fit_fold(folded, holdout, preps[holdout], apart, task, cv.scheme, labels[holdout])

            per_fold = in_threads(df.sparkSession, fit, range(cv.n_splits), parallelism)
            fitted |= {name: [by_name[name] for by_name in per_fold] for name in apart}
        fitted = {name: fitted[name] for name in named}
        parts = [
            _score_fold(folded, holdout, model, name, id_col, task)
            for name, by_fold in fitted.items() for holdout, model in enumerate(by_fold)
        ]
        oof = written(
            reduce(DataFrame.unionByName, parts).withColumn("run_id", F.lit(run_id)), "oof"
        )
    finally:
        folded.unpersist()

    found = metric(oof, models.LABEL, "oof", ["model", splits.FOLD]).collect()
    values = {(r["model"], r[splits.FOLD]): r[metric.name] for r in found}
    scores = {n: [values.get((n, i)) for i in range(cv.n_splits)] for n in named}
    for name, fold_scores in scores.items():
        if None in fold_scores:
            log.warning("model %s has folds without a score (one class or no rows)", name)
    return Run(
        run_id=run_id,
        id_col=id_col,
        target=target,
        task=task,
        metric=metric,
        best=pick_best(scores, metric.direction),
        params={n: dict(s.params) for n, s in named.items()},
        scores=scores,
        oof=oof,
        models=fitted,
        features=features,
        cv=cv,
    )


def pick_best(scores: dict[str, list[float | None]], direction: metrics.Direction) -> str:
    """Best mean over the folds that have a score; the first of equals."""
    means = {}
    for name, fold_scores in scores.items():
        known = [s for s in fold_scores if s is not None]
        if known:
            means[name] = sum(known) / len(known)
    if not means:
        raise TrainingError("no model has a score on any fold")
    choose = max if direction is metrics.Direction.MAXIMIZE else min
    return choose(means, key=means.get)


def refit(run: Run, df: DataFrame) -> PipelineModel:
    """The run's best model fitted on all rows."""
    exclude = [run.id_col, run.target, models.LABEL]
    labelled = df.withColumn(models.LABEL, F.col(run.target).cast("double"))
    whole = labelled.withColumn(splits.FOLD, F.lit(-1)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        prep = preprocess.learn(whole, run.features, 1, "kfold", exclude)[0]
        spec = ModelSpec(run.best, run.params[run.best])
        together = _fit_together(whole, [prep], {run.best: spec}, run.task, "kfold", run.id_col)
        if together:
            return together[run.best][0]
        labels = _training_labels(whole, 1, "kfold")[0]
        return _fit_fold(whole, 0, prep, {run.best: spec}, run.task, "kfold", labels)[run.best]
    finally:
        whole.unpersist()
