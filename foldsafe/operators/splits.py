"""Fold assignment: plain, stratified, by group and by time.

Folds depend only on ids, labels and the seed: not on partitioning, file order or task retries.
Ids must be unique (`contracts.report` counts repeats); repeats of one id share a fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsafe.config import MOST_CLASSES, CVConfig
from foldsafe.errors import SchemaError
from foldsafe.functions.numeric import hash_key
from foldsafe.functions.text import null_as_text
from foldsafe.operators import ranks
from foldsafe.operators.cells import hash_cell, hash_digits
from foldsafe.operators.joins import lookup
from foldsafe.sources.scratch import written

FOLD = "fold"
# Groups with at least 1/(this x folds) of all rows are placed one by one, the rest by volume.
_PLACED_PER_FOLD = 1000


def kfold(
    df: DataFrame, id_col: str, n_splits: int = 5, seed: int = 42, shuffle: bool = True
) -> DataFrame:
    """Equal consecutive blocks (sizes differ by at most one) of the hash order, or of the id order."""

    def start(i: Column, rows: Column, first: Column) -> Column:
        size = F.floor(rows / n_splits)
        return i * size + F.least(i, rows % n_splits)

    order_col = None if shuffle else id_col
    return ranks.cut_blocks(df, id_col, n_splits - 1, start, seed, None, order_col, FOLD)


def stratified(
    df: DataFrame,
    id_col: str,
    target: str,
    n_splits: int = 5,
    seed: int = 42,
    most_classes: int = MOST_CLASSES,
) -> DataFrame:
    """Folds of equal size in which each class has an equal share, both to within one row.

    Rows sorted by class are dealt to folds in turn; that fixes how many rows of a class each fold
    gets, and the class's hash order says which. Rows without a label are a class of their own. A target
    with fractions, or with more than ``most_classes`` values, is no set of classes: an error.
    """
    kind = df.schema[target].dataType
    label = F.col(target)
    broken = F.count_if(label != F.floor(label)) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.lit(0)
    # Exact up to the limit: one row per class leaves each task.
    classes = df.select(target).distinct().limit(most_classes + 1).count()
    if classes > most_classes or df.agg(broken).first()[0]:
        raise SchemaError(f"{target} has too many values or fractions for stratified folds")

    def dealt(i: Column, rows: Column, first: Column) -> Column:
        def up_to(end: Column, fold: Column) -> Column:
            return F.floor((end - 1 - fold + n_splits) / n_splits)

        earlier = F.sequence(F.lit(0).cast("bigint"), i - 1)
        each = F.transform(earlier, lambda f: up_to(first + rows, f) - up_to(first, f))
        return F.aggregate(each, F.lit(0).cast("bigint"), lambda a, b: a + b)

    return ranks.cut_blocks(df, id_col, n_splits - 1, dealt, seed, target, None, FOLD, classes)


def timeseries(df: DataFrame, id_col: str, time_col: str, n_splits: int = 5, seed: int = 42) -> DataFrame:
    """Blocks of ``rows // (n_splits + 1)`` at the end of the time order; -1 marks earlier rows.

    Fold ``i`` is trained on every row with a smaller fold number. Rows of one instant are in hash
    order.
    """

    def start(i: Column, rows: Column, first: Column) -> Column:
        size = F.floor(rows / (n_splits + 1))
        return rows - (F.lit(n_splits + 1) - i) * size

    blocks = ranks.cut_blocks(df, id_col, n_splits, start, seed, None, time_col, FOLD)
    return blocks.withColumn(FOLD, F.col(FOLD) - 1)


def _place_in_turn(large: DataFrame, n_splits: int) -> DataFrame:
    """Give each large group, biggest first, to the lightest fold so far.

    At most ``_PLACED_PER_FOLD x n_splits`` groups can be large, so one array holds them.
    """
    queue = F.array_sort(F.collect_list(F.struct(-F.col("rows"), F.col("group"))))
    bare = large.agg(queue.alias("queue"))
    empty = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), n_splits).alias("loads"),
        F.array().cast("array<int>").alias("folds"),
    )

    def give(state: Column, entry: Column) -> Column:
        loads = state["loads"]
        lightest = F.array_position(loads, F.array_min(loads)).cast("int") - 1
        grown = F.transform(
            loads, lambda load, i: F.when(i == lightest, load - entry["col1"]).otherwise(load)
        )
        return F.struct(
            grown.alias("loads"), F.concat(state["folds"], F.array(lightest)).alias("folds")
        )

    placed = bare.select("queue", F.aggregate("queue", empty, give).alias("done"))
    return placed.select(
        F.arrays_zip(
            F.transform("queue", lambda e: e["group"]).alias("group"),
            F.col("done.folds").alias("fold"),
            F.transform("queue", lambda e: -e["col1"]).alias("rows"),
        ).alias("pairs"),
        F.col("done.loads").alias("loads"),
    )


def _fill_levels(loads: DataFrame, small_rows: Column, n_splits: int) -> DataFrame:
    """Range of the small groups' running volume that each fold takes to reach an equal level."""
    flat = loads.select(F.posexplode("loads").alias("fold", "load"), small_rows.alias("volume"))
    rising = Window.partitionBy(F.lit(0)).orderBy("load", "fold")
    everyone = Window.partitionBy(F.lit(0))
    by_fold = Window.partitionBy(F.lit(0)).orderBy("fold")
    # Filling the j lightest folds evenly needs level (volume + their load) / j; the lowest holds.
    level = (F.col("volume") + F.sum("load").over(rising)) / F.row_number().over(rising)
    room = (
        flat.withColumn("level", level)
        .withColumn("level", F.min("level").over(everyone))
        .withColumn("room", F.greatest(F.lit(0.0), F.col("level") - F.col("load")))
    )
    return room.select("fold", F.sum("room").over(by_fold).alias("until"))


def _group_key(group: Column) -> Column:
    """Text form of a group in which rows without a group are one group of their own."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("none"))


def group(
    df: DataFrame, group_col: str, n_splits: int = 5, seed: int = 42, placed: int = _PLACED_PER_FOLD
) -> DataFrame:
    """Keep each group in one fold and balance fold sizes.

    Groups big enough to matter are placed one at a time on the lightest fold, biggest first, equal
    sizes in group order. There can be at most ``placed x n_splits`` of those. All others are
    smaller than that share of a fold, so they are laid end to end in hash order and cut where the
    folds reach an equal level.
    """
    # Written once: everything below reads the group sizes, not the table again.
    sizes = written(df.groupBy(F.col(group_col).alias("group")).agg(F.count(F.lit(1)).alias("rows")), "groups")
    total = sizes.agg(F.sum("rows")).scalar()
    is_large = F.col("rows") * F.lit(placed * n_splits) >= total
    done = _place_in_turn(sizes.filter(is_large), n_splits)
    large = done.select(F.inline("pairs").alias("group", FOLD, "rows")).select("group", "rows", FOLD)

    digits = hash_digits(df.sparkSession)
    mixed = hash_key(null_as_text(F.col("group")), seed)
    small = sizes.filter(~is_large).withColumns({"_h": mixed, "_cell": hash_cell(mixed, digits)})
    laid = ranks.running_totals(small, [], "_cell", ["_h", "group"], ["rows"])
    volume = F.coalesce(small.agg(F.sum("rows")).scalar(), F.lit(0))
    levels = _fill_levels(done, volume, n_splits)
    ends = levels.agg(F.sort_array(F.collect_list("until"))).scalar()
    passed = F.size(F.filter("_ends", lambda end: end <= F.col("rows_before")))
    cut = laid.withColumn("_ends", ends).select(
        "group", "rows", F.least(passed, F.lit(n_splits - 1)).alias(FOLD)
    )
    folds = written(large.unionByName(cut).withColumn("_key", _group_key(F.col("group"))), "group-folds")
    return lookup(df, _group_key(F.col(group_col)), folds, "_key", [FOLD], "rows", folds.count())


def assign(df: DataFrame, cfg: CVConfig, id_col: str, target: str | None = None) -> DataFrame:
    """Add ``fold`` by the configured scheme."""
    needed = {"stratified": target, "group": cfg.group_column, "timeseries": cfg.time_column}
    column = needed.get(cfg.scheme, id_col)
    if column is None or column not in df.columns or id_col not in df.columns:
        raise SchemaError(f"the {cfg.scheme} scheme needs columns {id_col!r} and {column!r}")
    if cfg.scheme == "kfold":
        return kfold(df, id_col, cfg.n_splits, cfg.random_state, cfg.shuffle)
    if cfg.scheme == "stratified":
        return stratified(df, id_col, target, cfg.n_splits, cfg.random_state, cfg.most_classes)
    if cfg.scheme == "group":
        return group(df, cfg.group_column, cfg.n_splits, cfg.random_state)
    return timeseries(df, id_col, cfg.time_column, cfg.n_splits, cfg.random_state)


def trains_on(scheme: str, fold: Column, holdout: Column | int) -> Column:
    """Whether rows of ``fold`` may be learnt from when ``holdout`` is scored."""
    return fold < holdout if scheme == "timeseries" else fold != holdout


def training_folds(scheme: str, n_splits: int, holdout: int) -> list[int]:
    """The folds, from -1 (never held out), whose rows `trains_on` allows for a holdout."""
    return [f for f in range(-1, n_splits) if (f < holdout if scheme == "timeseries" else f != holdout)]
