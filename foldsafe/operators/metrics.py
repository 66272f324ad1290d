"""Exact metrics as small tables, for any number of models, folds or runs in one job."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldsafe.errors import MetricError
from foldsafe.functions.numeric import known, over_threshold
from foldsafe.operators.cells import CELL, NumericCells


class Direction(str, Enum):
    # These texts stand in result tables.
    MAXIMIZE = "maximize"
    MINIMIZE = "minimize"


def _usable(df: DataFrame, label: str, pred: str, by: Sequence[str]) -> DataFrame:
    return df.select(
        *by, F.col(label).cast("double").alias("_y"), known(F.col(pred)).alias("_p")
    ).filter(F.col("_y").isNotNull() & F.col("_p").isNotNull())


def rmse(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Root mean squared error per group."""
    error = F.pow(F.col("_y") - F.col("_p"), F.lit(2.0))
    return _usable(df, label, pred, by).groupBy(*by).agg(F.sqrt(F.avg(error)).alias("rmse"))


def accuracy(
    df: DataFrame,
    label: str,
    pred: str,
    by: Sequence[str] = (),
    threshold: float | Column = 0.5,
) -> DataFrame:
    """Share of rows whose thresholded score equals the label, with the number of rows."""
    right = (over_threshold(F.col(pred), threshold) == F.col(label)).cast("double")
    return df.groupBy(*by).agg(F.avg(right).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def auc(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact area under the ROC curve per group; tied scores count half, one class gives null.

    Rows are first counted per distinct score, so tied scores of any weight are one row. Areas are
    then added inside score cells and across cells, so a group is never sorted in one task.
    """
    rows = _usable(df, label, pred, by)
    cells = NumericCells.learn(rows, F.col("_p"))
    scores = rows.groupBy(*by, "_p").agg(
        F.count_if(F.col("_y") > 0).alias("pos"), F.count_if(F.col("_y") <= 0).alias("neg")
    )
    celled = cells.add(scores, F.col("_p"))
    in_cell = Window.partitionBy(*by, CELL).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    beaten = F.coalesce(F.sum("neg").over(in_cell), F.lit(0)) + F.col("neg") / 2
    by_cell = (
        celled.withColumn("area", F.col("pos") * beaten)
        .groupBy(*by, CELL)
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum("area").alias("area"))
    )
    lower = Window.partitionBy(*by, F.lit(0)).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    over_cells = F.col("area") + F.col("pos") * F.coalesce(F.sum("neg").over(lower), F.lit(0))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return (
        by_cell.withColumn("area", over_cells)
        .groupBy(*by)
        .agg(F.try_divide(F.sum("area"), pairs).alias("auc"))
    )


@dataclass(frozen=True)
class Metric:
    """A named metric: ``metric(df, label, pred, by)`` gives one row per group, column ``name``."""

    name: str
    direction: Direction
    table: Callable[..., DataFrame]

    def __call__(self, df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
        return self.table(df, label, pred, by)


RMSE = Metric("rmse", Direction.MINIMIZE, rmse)
AUC = Metric("auc", Direction.MAXIMIZE, auc)
_BY_TASK = {"regression": RMSE, "binary": AUC}


def get(task: str, name: str = "") -> Metric:
    """Metric of a task; a name that does not belong to the task gives the task's own metric."""
    if task not in _BY_TASK:
        raise MetricError(f"no metric for task {task!r} ({name or 'default'})")
    return _BY_TASK[task]


def align(oof: DataFrame, labels: DataFrame, id_col: str, target: str) -> DataFrame:
    """Out-of-fold rows with their label, matched by id. Never by position."""
    return oof.join(labels.select(id_col, target), id_col)


def alignment_drift(oof: DataFrame, labels: DataFrame, id_col: str, target: str) -> DataFrame:
    """Rows before and after the join with labels, to notice ids that do not match."""
    before = oof.agg(F.count(F.lit(1)).alias("oof_rows"))
    joined = align(oof, labels, id_col, target).agg(F.count(F.lit(1)))
    return before.withColumn("joined_rows", joined.scalar())


def evaluate_oof(
    oof: DataFrame, labels: DataFrame, id_col: str, target: str, threshold: float = 0.5
) -> DataFrame:
    """``(run_id, metric, value, n)`` per run: accuracy at a threshold."""
    scored = accuracy(align(oof, labels, id_col, target), target, "oof", ["run_id"], threshold)
    return scored.select(
        "run_id", F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value"), "n"
    )


def fold_summary(scores: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean, population deviation and the list of fold scores in fold order."""
    ordered = F.array_sort(F.collect_list(F.struct("fold", "score")))
    return scores.groupBy(*by).agg(
        F.transform(ordered, lambda s: s["score"]).alias("fold_scores"),
        F.avg("score").alias("score_mean"),
        F.stddev_pop("score").alias("score_std"),
    )


def best_model(summary: DataFrame, direction: Direction) -> DataFrame:
    """The model with the best mean score in the metric's own direction; names break ties."""
    mean = F.col("score_mean")
    order = mean.desc_nulls_last() if direction is Direction.MAXIMIZE else mean.asc_nulls_last()
    return summary.orderBy(order, "model").limit(1)
