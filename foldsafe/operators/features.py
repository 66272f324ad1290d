"""Engineered features: stateless columns, and two that learn from training rows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsafe.config import FeaturesConfig
from foldsafe.functions import numeric, text
from foldsafe.operators.joins import lookup
from foldsafe.sources.scratch import written
from foldsafe.operators.splits import FOLD, trains_on

FAMILY = "FamilySize"
ALONE = "IsAlone"
TITLE = "Title"
DECK = "Deck"
TICKET_GROUP = "TicketGroupSize"
LOG_FARE = "LogFare"
AGE_BIN = "AgeBin"


def available(columns: list[str], cfg: FeaturesConfig) -> tuple[list[str], list[str]]:
    """Numeric and text features that the given columns support under these settings."""
    c = cfg.columns
    family = c.siblings in columns and c.parents in columns
    numbers = [
        (cfg.add_family and family, FAMILY),
        (cfg.add_is_alone and (family or FAMILY in columns), ALONE),
        (cfg.add_ticket_group_size and c.ticket in columns, TICKET_GROUP),
        (cfg.log_fare and c.fare in columns, LOG_FARE),
    ]
    texts = [
        (cfg.add_title and c.name in columns, TITLE),
        (cfg.add_deck and c.cabin in columns, DECK),
        (cfg.bin_age and c.age in columns, AGE_BIN),
    ]
    return [n for on, n in numbers if on], [n for on, n in texts if on]


def stateless(df: DataFrame, cfg: FeaturesConfig) -> DataFrame:
    """Add every feature that needs only its own row; the title is not yet merged into Rare."""
    c = cfg.columns
    wanted = sum(available(df.columns, cfg), [])
    has_family = c.siblings in df.columns and c.parents in df.columns
    made: dict[str, Column] = {}
    size = numeric.family_size(F.col(c.siblings), F.col(c.parents)) if has_family else None
    if FAMILY in wanted:
        made[FAMILY] = size
    if ALONE in wanted:
        # A family size that is already a column wins unless it is being made here.
        given = FAMILY in df.columns and FAMILY not in wanted
        made[ALONE] = numeric.is_alone(F.col(FAMILY) if given or size is None else size)
    if TITLE in wanted:
        made[TITLE] = text.normal_title(F.col(c.name))
    if DECK in wanted:
        made[DECK] = text.deck(F.col(c.cabin))
    if LOG_FARE in wanted:
        made[LOG_FARE] = numeric.log_amount(F.col(c.fare))
    if AGE_BIN in wanted:
        made[AGE_BIN] = numeric.age_bin(F.col(c.age))
    return df.withColumns(made) if made else df


def key_counts(df: DataFrame, key: Column) -> DataFrame:
    """``(key, n)``: rows per key, a missing key counted under the text ``nan``."""
    return df.groupBy(text.null_as_text(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def rare_title(title: Column, count: Column, threshold: int) -> Column:
    """``Rare`` for a title seen in training, but too seldom; an unseen title stays as it is."""
    return F.when(count < threshold, F.lit(text.RARE_TITLE)).otherwise(title)


def fold_counts(df: DataFrame, key: Column, n_splits: int) -> DataFrame:
    """``(key, by_fold)``: rows per key in every fold, from -1 (never held out) to the last.

    One pass replaces a count per fold: what a fold may learn is the sum over its training folds.
    """
    by_fold = F.array(
        *[F.count_if(F.col(FOLD) == f) for f in range(-1, n_splits)]
    )
    return df.groupBy(text.null_as_text(key).alias("key")).agg(by_fold.alias("by_fold"))


def training_count(by_fold: Column, holdout: Column, n_splits: int, scheme: str) -> Column:
    """Rows of the folds that a holdout is trained on."""
    total = F.lit(0).cast("bigint")
    for f in range(-1, n_splits):
        used = trains_on(scheme, F.lit(f), holdout)
        total = total + F.when(used, F.get(by_fold, F.lit(f + 1))).otherwise(0)
    return total


def _counted(df: DataFrame, key: Column, n_splits: int) -> tuple[DataFrame, int]:
    """Rows per key and fold, written once, and the number of keys."""
    counts = fold_counts(df, key, n_splits).withColumn(
        "_rows", F.aggregate("by_fold", F.lit(0).cast("bigint"), lambda a, b: a + b)
    )
    counts = written(counts, "fold-counts")
    return counts, counts.count()


def _join_counts(
    df: DataFrame, key: Column, counted: tuple[DataFrame, int], n_splits: int, scheme: str, name: str
) -> DataFrame:
    """Add how often the row's key occurs in the training rows of the row's own fold.

    The count table has one row per key, so the join adds no rows.
    """
    counts, size = counted
    joined = lookup(df, text.null_as_text(key), counts, "key", ["by_fold"], "_rows", size)
    count = training_count(F.col("by_fold"), F.col(FOLD), n_splits, scheme)
    return joined.withColumn(name, count).drop("by_fold")


def leave_fold_out(
    folded: DataFrame, cfg: FeaturesConfig, n_splits: int, scheme: str = "stratified"
) -> DataFrame:
    """All features of every row, learnt parts taken from the folds its own fold is trained on."""
    wanted = sum(available(folded.columns, cfg), [])
    df = stateless(folded, cfg)
    # Both counts come from the table itself, before any look-up widens it.
    keys = {TICKET_GROUP: cfg.columns.ticket, TITLE: TITLE}
    tables = {name: _counted(df, F.col(key), n_splits) for name, key in keys.items() if name in wanted}
    if TICKET_GROUP in wanted:
        df = _join_counts(df, F.col(cfg.columns.ticket), tables[TICKET_GROUP], n_splits, scheme, TICKET_GROUP)
        seen = F.col(TICKET_GROUP)
        df = df.withColumn(TICKET_GROUP, F.when(seen > 0, seen).otherwise(1).cast("int"))
    if TITLE in wanted:
        df = _join_counts(df, F.col(TITLE), tables[TITLE], n_splits, scheme, "_seen")
        seen = F.when(F.col("_seen") > 0, F.col("_seen"))
        df = df.withColumn(TITLE, rare_title(F.col(TITLE), seen, cfg.rare_title_threshold)).drop("_seen")
    return df
