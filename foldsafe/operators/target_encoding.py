"""Levels of text columns as numbers learnt from the target, without a row seeing its own label.

Two encoders, each for all holdouts at once:

* `smoothed`: the level's mean target, drawn towards the overall mean. A held-out row gets the mean over the training folds. A
  training row gets it over the training folds other than its own, so a model trained on the encoding cannot read the
  row's label back. Sums per level and fold are counted once; every mean is a total less a fold or two.
* `ordered`: the level's mean target over the rows that come before in a fixed hash order, as running totals. A held-out row
  gets the mean over all training rows of the level. Totals run over cells of the hash first and inside a cell second, so
  a level that holds a third of all rows is never in one task.

A null level is a level of its own. Rows without a label count nowhere but are encoded. A level not seen in training
gets the prior.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldsafe.errors import SchemaError
from foldsafe.functions.numeric import hash_key
from foldsafe.functions.text import null_as_text
from foldsafe.operators.cells import hash_cell, hash_digits
from foldsafe.operators.joins import lookup
from foldsafe.operators.small import rows_of
from foldsafe.operators.splits import FOLD, trains_on
from foldsafe.sources.scratch import written


def _long(folded: DataFrame, id_col: str, columns: Sequence[str], target: str) -> DataFrame:
    """``(id, fold, y, column, level)``: a row per row and column."""
    if not columns:
        raise SchemaError("there are no columns to encode")
    texts = [null_as_text(F.col(f"`{c}`")).alias(c) for c in columns]
    wide = folded.select(F.col(id_col).alias("_id"), FOLD, F.col(target).cast("double").alias("_y"), *texts)
    return wide.unpivot(["_id", FOLD, "_y"], list(columns), "column", "level")


def _folds(n_splits: int) -> range:
    """All folds there can be: rows that are never held out are in fold -1."""
    return range(-1, n_splits)


def _by_fold(n_splits: int) -> list[Column]:
    """Labelled rows and their sum in each fold, as columns n0, s0 (fold -1), n1, s1 (fold 0) and so on."""
    parts = []
    for f in _folds(n_splits):
        inside = F.when(F.col(FOLD) == f, F.col("_y"))
        parts += [F.count(inside).alias(f"n{f + 1}"), F.coalesce(F.sum(inside), F.lit(0.0)).alias(f"s{f + 1}")]
    return parts


def _added(kind: str, n_splits: int, scheme: str, holdout: int, but: Column | None = None) -> Column:
    """The sum of the columns of a holdout's training folds, but for one fold."""
    parts = []
    for f in _folds(n_splits):
        used = trains_on(scheme, F.lit(f), holdout)
        if but is not None:
            used = used & (but != f)
        parts.append(F.when(used, F.col(f"{kind}{f + 1}")).otherwise(F.lit(0)))
    return sum(parts[1:], parts[0])


def smoothed(
    folded: DataFrame,
    id_col: str,
    columns: Sequence[str],
    target: str,
    n_splits: int,
    scheme: str = "stratified",
    smoothing: float = 20.0,
) -> DataFrame:
    """``(id, fold, column, holdout, encoded)`` for every row, column and holdout that trains on or holds out the row.

    ``encoded`` is (sum + smoothing * prior) / (rows + smoothing); the prior is the mean target of the same folds.
    """
    if not smoothing > 0:
        raise SchemaError("smoothing must be positive")
    long = _long(folded, id_col, columns, target)
    counts = long.groupBy("column", "level").agg(*_by_fold(n_splits))
    names = [f"{kind}{f + 1}" for f in _folds(n_splits) for kind in "ns"]
    weight = sum((F.col(f"n{f + 1}") for f in _folds(n_splits)), F.lit(0))
    table = written(counts.select(_key().alias("_level_key"), *names, weight.alias("_rows")), "target-sums")
    found = lookup(long.drop("_y"), _key(), table, "_level_key", names, "_rows", table.count())
    # One row of sums per fold.
    totals = folded.select(FOLD, F.col(target).cast("double").alias("_y")).agg(*_by_fold(n_splits)).first()
    overall = {n: F.lit(totals[n]) for n in names}
    views = []
    for h in range(n_splits):
        own = F.col(FOLD)
        n, s = (F.coalesce(_added(k, n_splits, scheme, h, own), F.lit(0)) for k in "ns")
        prior = _prior(overall, n_splits, scheme, h, own)
        views.append(F.struct(
            F.lit(h).alias("holdout"), ((s + smoothing * prior) / (n + F.lit(float(smoothing)))).alias("encoded")
        ))
    return _seen(found.select("_id", FOLD, "column", rows_of(views)), scheme).withColumnRenamed("_id", id_col)


def _prior(overall: dict[str, Column], n_splits: int, scheme: str, holdout: int, but: Column) -> Column:
    n, s = F.lit(0), F.lit(0.0)
    for f in _folds(n_splits):
        used = trains_on(scheme, F.lit(f), holdout) & (but != f)
        n, s = n + F.when(used, overall[f"n{f + 1}"]).otherwise(0), s + F.when(used, overall[f"s{f + 1}"]).otherwise(0.0)
    return F.coalesce(F.try_divide(s, n), F.lit(0.0))


def _key() -> Column:
    """Column and level as one key."""
    return F.concat(F.length("column").cast("string"), F.lit("|"), F.col("column"), F.col("level"))


def _seen(views: DataFrame, scheme: str) -> DataFrame:
    """The holdouts that train on a row's fold, or hold it out."""
    return views.filter((F.col(FOLD) == F.col("holdout")) | trains_on(scheme, F.col(FOLD), F.col("holdout")))


def ordered(
    folded: DataFrame,
    id_col: str,
    columns: Sequence[str],
    target: str,
    n_splits: int,
    scheme: str = "stratified",
    prior: float = 0.5,
    weight: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """``(id, fold, column, holdout, encoded)`` like `smoothed`, from the rows before each in the order of a hash of the id.

    ``encoded`` is (sum + weight * prior) / (rows + weight) with a fixed prior, so that no label enters otherwise.
    """
    if not weight > 0:
        raise SchemaError("the prior's weight must be positive")
    digits = hash_digits(folded.sparkSession)
    long = _long(folded, id_col, columns, target).withColumn("_hash", hash_key(F.col("_id"), seed))
    long = written(long.withColumn("_cell", hash_cell(F.col("_hash"), digits)), "ordered-rows")
    names = [f"{kind}{f + 1}" for f in _folds(n_splits) for kind in "ns"]
    cells = long.groupBy("column", "level", "_cell").agg(*_by_fold(n_splits))
    # A level has at most as many rows here as there are cells, whatever the table's size.
    whole = Window.partitionBy("column", "level")
    before = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.select(
        F.col("column").alias("_column"), F.col("level").alias("_level"), F.col("_cell").alias("_at"),
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in names],
        *[F.sum(n).over(whole).alias(f"_all_{n}") for n in names],
    )
    placed = written(placed, "ordered-cells")
    inside = Window.partitionBy("column", "level", "_cell").orderBy("_hash", "_id").rowsBetween(Window.unboundedPreceding, -1)
    local = {}
    for f in _folds(n_splits):
        own = F.when(F.col(FOLD) == f, F.col("_y"))
        local[f"_in_n{f + 1}"] = F.count(own).over(inside)
        local[f"_in_s{f + 1}"] = F.coalesce(F.sum(own).over(inside), F.lit(0.0))
    same = [F.col("column") == F.col("_column"), F.col("level") == F.col("_level"), F.col("_cell") == F.col("_at")]
    joined = long.withColumns(local).join(placed, same)
    held_out = [F.col(f"_all_{n}").alias(n) for n in names]
    running = [(F.col(f"_before_{n}") + F.col(f"_in_{n}")).alias(n) for n in names]
    both = joined.select("_id", FOLD, "column", F.struct(*running).alias("run"), F.struct(*held_out).alias("all"))
    views = []
    for h in range(n_splits):
        n = s = F.lit(0.0)
        for f in _folds(n_splits):
            counts = trains_on(scheme, F.lit(f), h)
            part = F.when(F.col(FOLD) == h, F.col("all")).otherwise(F.col("run"))
            n = n + F.when(counts, part[f"n{f + 1}"]).otherwise(0)
            s = s + F.when(counts, part[f"s{f + 1}"]).otherwise(0.0)
        views.append(F.struct(F.lit(h).alias("holdout"), ((s + weight * prior) / (n + weight)).alias("encoded")))
    return _seen(both.select("_id", FOLD, "column", rows_of(views)), scheme).withColumnRenamed("_id", id_col)
