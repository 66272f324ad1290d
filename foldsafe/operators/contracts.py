"""Checks of the tables a job is given. Name checks cost no job; value checks share one pass each."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsafe.errors import InferenceError, SchemaError, TrainingError
from foldsafe.operators.small import rows_of


def require_columns(df: DataFrame, names: Iterable[str], table: str = "table") -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise SchemaError(f"{table} has no column {', '.join(missing)}")


def require_binary(task: str) -> None:
    if task != "binary":
        raise InferenceError(f"only binary tasks can be scored with a threshold, not {task!r}")


def require_threshold(threshold: float) -> None:
    if not 0.0 <= threshold <= 1.0:
        raise InferenceError(f"threshold {threshold} is outside 0 to 1")


def require_target(df: DataFrame, target: str | None) -> None:
    if not target:
        raise TrainingError("a target column is needed")
    require_columns(df, [target], "training table")


def roles(df: DataFrame, exclude: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """Sorted numeric and sorted other columns; true/false columns are not numeric."""
    left_out = set(exclude)
    fields = [f for f in df.schema.fields if f.name not in left_out]
    numeric = sorted(f.name for f in fields if isinstance(f.dataType, T.NumericType))
    other = sorted(f.name for f in fields if not isinstance(f.dataType, T.NumericType))
    return numeric, other


def role_table(df: DataFrame, exclude: Iterable[str] = ()) -> DataFrame:
    """One row per feature column: its role, place in the role's sorted list and filled rows."""
    lists = dict(zip(("numeric", "text"), roles(df, exclude)))
    names = [(role, i, n) for role, cols in lists.items() for i, n in enumerate(cols)]
    filled = df.agg(*[F.count(F.col(n)).alias(n) for _, _, n in names])
    structs = [
        F.struct(
            F.lit(n).alias("column"),
            F.lit(role).alias("role"),
            F.lit(i).alias("place"),
            F.col(n).alias("filled"),
        )
        for role, i, n in names
    ]
    return filled.select(rows_of(structs))


def report(
    train: DataFrame,
    id_col: str,
    target: str,
    oof: DataFrame,
    score: str = "oof",
) -> DataFrame:
    """Findings ``(finding, rows, ok)`` on a training table and its out-of-fold scores.

    Each table is reduced to one row per id first, so a repeated id costs no more than its copies.
    """
    ids = train.groupBy(id_col).agg(F.count(F.lit(1)).alias("train_rows"))
    scored = oof.groupBy(id_col).agg(F.count(F.lit(1)).alias("oof_rows"))
    matched = ids.join(scored, id_col, "full")
    on_ids = matched.agg(
        F.sum(F.coalesce("train_rows", F.lit(0))).alias("train rows"),
        F.sum(F.coalesce("oof_rows", F.lit(0))).alias("oof rows"),
        F.sum(F.greatest(F.col("train_rows") - 1, F.lit(0))).alias("repeated train ids"),
        F.sum(F.greatest(F.col("oof_rows") - 1, F.lit(0))).alias("repeated oof ids"),
        F.count_if(F.col("oof_rows").isNull()).alias("train ids without oof"),
        F.count_if(F.col("train_rows").isNull()).alias("oof ids without label"),
    )
    on_target = train.agg(
        F.count_if(F.col(target).isNull()).alias("missing targets"),
        F.count_if(~F.col(target).isin(0, 1)).alias("targets not 0 or 1"),
    )
    on_score = oof.agg(
        F.count_if(F.col(score).isNull()).alias("missing scores"),
        F.count_if((F.col(score) < 0) | (F.col(score) > 1)).alias("scores outside 0 to 1"),
    )
    return _findings(on_ids).unionByName(_findings(on_target)).unionByName(_findings(on_score))


def _findings(one_row: DataFrame) -> DataFrame:
    """Turn one row of named counts into rows; totals are always fine, faults must be 0."""
    structs = []
    for name in one_row.columns:
        rows = F.coalesce(F.col(f"`{name}`"), F.lit(0)).cast("bigint")
        fine = F.lit(True) if name in ("train rows", "oof rows") else rows == 0
        structs.append(F.struct(F.lit(name).alias("finding"), rows.alias("rows"), fine.alias("ok")))
    return one_row.select(rows_of(structs))
