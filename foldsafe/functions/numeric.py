"""Number features: family size, bins, log, sigmoid, thresholds and hash keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bin edges that define the age classes.
AGE_EDGES = (0, 5, 12, 18, 30, 45, 60, 80)


def family_size(siblings: Column, parents: Column) -> Column:
    return siblings.cast("double") + parents.cast("double") + F.lit(1.0)


def is_alone(size: Column) -> Column:
    """1 for a family of one, 0 otherwise and for a missing size."""
    return F.coalesce(size == 1, F.lit(False)).cast("int")


def log_amount(amount: Column) -> Column:
    return F.log1p(amount.cast("double"))


def bin_labels(edges: Sequence[float], include_lowest: bool = False) -> list[str]:
    """Interval texts of right-closed bins; the lowest bin opens just below its edge if included."""
    if not include_lowest:
        return [f"({lo}, {hi}]" for lo, hi in zip(edges, edges[1:])]
    lows = [float(edges[0]) - 0.001, *map(float, edges[1:-1])]
    return [f"({lo}, {float(hi)}]" for lo, hi in zip(lows, edges[1:])]


def right_closed_bin(column: Column, edges: Sequence[float], include_lowest: bool = False) -> Column:
    """Label of the bin (lo, hi] a value falls in, null outside all bins."""
    labels = bin_labels(edges, include_lowest)
    above_low = column >= edges[0] if include_lowest else column > edges[0]
    chain = F.when(above_low & (column <= edges[1]), F.lit(labels[0]))
    for lo, hi, label in zip(edges[1:], edges[2:], labels[1:]):
        chain = chain.when((column > lo) & (column <= hi), F.lit(label))
    return chain


def age_bin(age: Column) -> Column:
    """Age class as text, ``nan`` for a missing or out-of-range age."""
    return F.coalesce(right_closed_bin(age, AGE_EDGES), F.lit("nan"))


def sigmoid(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def known(column: Column) -> Column:
    """Numeric value with NaN read as missing, so both kinds of blank behave alike.

    Adding zero turns a negative zero into zero: cell search would put the two apart.
    """
    value = column.cast("double")
    return F.when(~F.isnan(value), value + F.lit(0.0))


def over_threshold(score: Column, threshold: float | Column, strict: bool = False) -> Column:
    """0/1 label; the cut itself passes unless ``strict``. A missing score never passes."""
    value = known(score)
    passed = value > threshold if strict else value >= threshold
    return F.coalesce(passed, F.lit(False)).cast("int")


def hash_key(row_id: Column, seed: int) -> Column:
    """Order key that shuffles rows the same way on every engine and any partitioning."""
    return F.md5(F.concat(row_id.cast("string"), F.lit(f"|{seed}")))
