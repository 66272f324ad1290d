"""Whole jobs on a store of runs: profile, train, evaluate, predict, ensemble, keep the ledger.

A store is a folder with tables: ``oof``, ``cv_summary``, ``oof_eval``, ``models``, ``ledger``. Each
job appends to them or writes a new result; none rewrites what another job may be reading.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsafe.config import CVConfig, FeaturesConfig, ModelSpec
from foldsafe.errors import InferenceError, SchemaError
from foldsafe.functions import snapshot
from foldsafe.operators import (
    ensemble,
    ledger,
    metrics,
    profile,
    scoring,
    thresholds,
    training,
)
from foldsafe.operators.contracts import (
    require_binary,
    require_columns,
    require_target,
    require_threshold,
)
from foldsafe.operators.small import table
from foldsafe.sources import csv, run_folders, runs
from foldsafe.sources.scratch import written

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Store:
    """A folder of runs and the roles of the columns they are about."""

    spark: SparkSession
    path: str
    id_col: str
    target: str
    task: str = "binary"
    competition: str = ""

    def summaries(self) -> DataFrame:
        """The last saved summary of every run."""
        found = runs.read_documents(self.spark, f"{self.path}/cv_summary", runs.SUMMARY_SCHEMA)
        return runs.last_saved(found)

    def evaluations(self) -> DataFrame:
        """The last evaluation of every run; a store without any gives an empty table."""
        found = runs.read_if_any(self.spark, f"{self.path}/oof_eval", runs.EVAL_SCHEMA)
        return runs.last_saved(found).select("run_id", "metric", "value")

    def metrics(self) -> DataFrame:
        known = self.summaries()
        return runs.run_metrics(known, known, self.evaluations())

    def run_id(self, run_id: str | None = None) -> str:
        return run_id or runs.latest_id(self.summaries())

    def oof(self, run_ids: Sequence[str]) -> DataFrame:
        """Out-of-fold rows of the runs' best models; other partitions are not read."""
        best = self.summaries().filter(F.col("run_id").isin(*run_ids)).select("run_id", "model")
        missing = sorted(set(run_ids) - {r["run_id"] for r in best.collect()})
        if missing:
            raise InferenceError(f"no summary for run {', '.join(missing)}")
        return self._oof_of(best)

    def every_oof(self) -> DataFrame:
        """Out-of-fold rows of the best model of every run that has a summary."""
        return self._oof_of(self.summaries().select("run_id", "model"))

    def _oof_of(self, best: DataFrame) -> DataFrame:
        # Runs and models are partition folders: Spark prunes them by the joined table at run time.
        rows = runs.read_oof(self.spark, f"{self.path}/oof")
        return rows.join(best, ["run_id", "model"], "left_semi").select("run_id", self.id_col, "fold", "oof")

    def ledger(self) -> DataFrame:
        return ledger.read(self.spark, f"{self.path}/ledger")


def _aligned(oof: DataFrame, labels: DataFrame, store: Store) -> None:
    """Refuse labels with repeated ids; warn if the join by id would lose or gain rows."""
    repeated = labels.groupBy(store.id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        raise SchemaError(f"labels repeat values of {store.id_col}")
    before, after = metrics.alignment_drift(oof, labels, store.id_col, store.target).first()
    if before != after:
        log.warning("%d of %d out-of-fold rows have a label", after, before)


def eda(df: DataFrame, out: str) -> DataFrame:
    """Describe every column and write the result as CSV."""
    found = profile.describe_all(df)
    csv.write(found, out)
    return found


def train(
    store: Store,
    df: DataFrame,
    cv: CVConfig,
    features: FeaturesConfig,
    specs: Sequence[ModelSpec],
    run_id: str | None = None,
    **extra: Any,
) -> training.Run:
    """Cross-fit all models, keep the best one's report and every fold model."""
    if run_id is None:
        stamp = snapshot.run_stamp(F.current_timestamp())
        run_id = store.spark.range(1).select(stamp.alias("s")).first()["s"]
    run = training.cross_fit(
        df,
        cv,
        features,
        specs,
        id_col=store.id_col,
        target=store.target,
        task=store.task,
        run_id=run_id,
        **extra,
    )
    run.save(store.path)
    return run


def run_report(store: Store, out: str, run_id: str | None = None) -> str:
    """The Markdown report of a run, read back from the store and written as text."""
    name = store.run_id(run_id)
    found = training.run_report(store.summaries().filter(F.col("run_id") == name))
    row = found.first()
    if row is None:
        raise InferenceError(f"no summary for run {name}")
    found.select(F.col("report").alias("value")).coalesce(1).write.text(out)
    return row["report"]


def import_runs(store: Store, root: str, id_type: str = "bigint") -> DataFrame:
    """Take over runs that lie in a folder each: summaries, evaluations and out-of-fold rows.

    Returns all run folders with their metrics. A run without a readable summary or score list is listed
    but not taken over. Importing again replaces the rows of the same runs. Fold models are another
    library's files: they stay where they are, and the run counts as one without fold models.
    """
    found = written(run_folders.records(store.spark, root), "run-folders")
    known = run_folders.summaries(found).filter(F.col("model").isNotNull())
    no_models = F.array().cast("array<string>")
    # The run's name goes last, as in the table's own records.
    record = known.withColumns({"pipelines": no_models, "saved_at": F.current_timestamp()})
    runs.write_documents(record.select(*runs.SUMMARY_SCHEMA.names, "run_id"), f"{store.path}/cv_summary")
    tried = run_folders.evaluations(found).join(known.select("run_id"), "run_id", "left_semi")
    runs.write_documents(tried.withColumn("saved_at", F.current_timestamp()), f"{store.path}/oof_eval")
    rows = run_folders.read_oof(store.spark, root, store.id_col, id_type)
    named = rows.join(known.select("run_id", "model"), "run_id")
    runs.write_oof(
        named.select(store.id_col, F.lit(None).cast("int").alias("fold"), "oof", "run_id", "model"), f"{store.path}/oof"
    )
    return runs.run_metrics(found, run_folders.summaries(found), run_folders.evaluations(found))


def predict(
    store: Store, df: DataFrame, out: str, run_id: str | None = None, threshold: float = 0.5
) -> DataFrame:
    """Labels from the averaged fold models of a run, written as CSV."""
    require_binary(store.task)
    require_threshold(threshold)
    require_columns(df, [store.id_col], "test table")
    models = training.load_fold_models(store.spark, store.path, store.run_id(run_id))
    labels = scoring.predict(models, df, store.id_col, store.target, threshold)
    csv.write(labels, out)
    return labels


def eval_oof(store: Store, labels: DataFrame, run_id: str | None = None) -> DataFrame:
    """Accuracy of a run's out-of-fold scores at one half, added to the store."""
    require_binary(store.task)
    require_target(labels, store.target)
    name = store.run_id(run_id)
    _aligned(store.oof([name]), labels, store)
    found = metrics.evaluate_oof(store.oof([name]), labels, store.id_col, store.target)
    record = found.withColumns({"run_dir": F.col("run_id"), "saved_at": F.current_timestamp()})
    runs.write_documents(record, f"{store.path}/oof_eval")
    return found


def threshold_sweep(
    store: Store,
    labels: DataFrame,
    out: str,
    run_id: str | None = None,
    start: float = 0.0,
    stop: float = 1.0,
    step: float = 0.01,
) -> DataFrame:
    """Accuracy per threshold as CSV, the best one as JSON."""
    require_target(labels, store.target)
    oof = store.oof([store.run_id(run_id)])
    _aligned(oof, labels, store)
    scored = metrics.align(oof, labels, store.id_col, store.target)
    swept = thresholds.sweep(scored, store.target, "oof", start, stop, step)
    # A row per threshold: small, and read twice.
    swept = swept.persist()
    try:
        csv.write(swept.select("threshold", "accuracy"), f"{out}/oof_thresholds")
        best = thresholds.best(swept)
        best.write.json(f"{out}/best_threshold")
        row = best.first()
    finally:
        swept.unpersist()
    return table(store.spark, "best_threshold double, accuracy double", [tuple(row)])


def ensemble_predict(
    store: Store,
    run_ids: Sequence[str],
    df: DataFrame,
    out: str,
    labels: DataFrame | None = None,
    threshold: float | None = None,
) -> DataFrame:
    """Average several runs; cut at a threshold, or so that ones match the labels' prevalence."""
    require_columns(df, [store.id_col], "test table")
    if not run_ids:
        raise InferenceError("no runs to combine")
    if threshold is None:
        if labels is None:
            raise SchemaError("labels are needed to match their prevalence")
        require_target(labels, store.target)
        _aligned(store.oof(run_ids), labels, store)
        means = ensemble.mean_oof(store.oof(run_ids), labels, store.id_col, store.target)
        threshold = thresholds.prevalence_cut(means, "p", labels, store.target).threshold
    loaded = {name: training.load_fold_models(store.spark, store.path, name) for name in run_ids}
    means = scoring.run_average(loaded, df)
    result = ensemble.submission(means, store.id_col, threshold, store.target)
    csv.write(result, out)
    return result


def log_submission(
    store: Store,
    file: str,
    leaderboard_score: float,
    run_id: str | None = None,
    message: str | None = None,
    threshold: float | None = None,
    features: FeaturesConfig | None = None,
    specs: Sequence[ModelSpec] = (),
    cv: CVConfig | None = None,
) -> DataFrame:
    """Add one entry with the run's metrics and snapshots of the settings."""
    models = [{"name": s.name, "params": s.params} for s in specs]
    columns = (
        "competition string, file string, message string, run_id string, threshold double, "
        "leaderboard_score double, features_cfg string, models_cfg string, cv_cfg string"
    )
    row = (
        store.competition,
        file,
        message,
        run_id,
        threshold,
        float(leaderboard_score),
        json.dumps(features.flags()) if features else None,
        json.dumps(models) if models else None,
        json.dumps(cv.flags()) if cv else None,
    )
    entry = store.spark.createDataFrame([row], columns).withColumn(
        "timestamp", snapshot.ledger_stamp(F.current_timestamp())
    )
    recorded = ledger.record(entry, store.metrics())
    ledger.append(recorded, f"{store.path}/ledger")
    return recorded


def report_submissions(
    store: Store, submissions: DataFrame, labels: DataFrame, out: str
) -> DataFrame:
    """The ledger with run metrics, positive rates and accuracies, as CSV and JSON lines.

    ``submissions`` holds rows ``(file, id, target)`` of the submitted files.
    """
    oof = store.every_oof()
    report = ledger.report(
        store.ledger(),
        store.metrics(),
        submissions,
        oof,
        labels,
        store.id_col,
        store.target,
        label=store.target,
    )
    report.write.json(f"{out}/jsonl")
    stored = store.spark.read.schema(report.schema).json(f"{out}/jsonl")
    csv.write(stored, f"{out}/csv")
    return stored


def report_markdown(store: Store, report: DataFrame, out: str, k: int = 5) -> DataFrame:
    """Top entries by leaderboard score and by accuracy, as a Markdown text."""
    top = ledger.topk(report, store.ledger(), k)
    ledger.write_markdown(top, out)
    return top
