"""Profiles of a table: describe, missing values, group and bin rates, pivots, correlations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsafe.functions.numeric import AGE_EDGES, bin_labels, known, right_closed_bin
from foldsafe.operators import moments, quantiles
from foldsafe.operators.contracts import roles
from foldsafe.operators.small import rows_of, table
from foldsafe.sources.scratch import written

_NUMBERS = ("mean", "std", "min", "q25", "q50", "q75", "max")
# Correlations of up to this many columns are expressions of one aggregate.
_FEW_COLUMNS = 16
# Texts are told apart by 128 hashed bits; so many characters travel with the hashes.
_PREFIX = 64
# Hashes of candidates for the top text are broadcast up to this many, 24 bytes each.
_FEW_CANDIDATES = 200_000


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN where the type has one."""
    column = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def _describe_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    quarter = quantiles.exact(df, {c: F.col(f"`{c}`") for c in columns}, (0.25, 0.5, 0.75))
    parts = []
    for i, c in enumerate(columns):
        value = known(F.col(f"`{c}`"))
        parts += [
            F.count(value).alias(f"count_{i}"),
            F.avg(value).alias(f"mean_{i}"),
            F.stddev_samp(value).alias(f"std_{i}"),
            F.min(value).alias(f"min_{i}"),
            F.max(value).alias(f"max_{i}"),
            quarter[c].alias(f"quarters_{i}"),
        ]
    structs = []
    for i, c in enumerate(columns):
        quarters = F.col(f"quarters_{i}")
        structs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"count_{i}").alias("count"),
                F.lit(None).cast("bigint").alias("unique"),
                F.lit(None).cast("string").alias("top"),
                F.lit(None).cast("bigint").alias("freq"),
                F.col(f"mean_{i}").alias("mean"),
                F.col(f"std_{i}").alias("std"),
                F.col(f"min_{i}").alias("min"),
                quarters[0].alias("q25"),
                quarters[1].alias("q50"),
                quarters[2].alias("q75"),
                F.col(f"max_{i}").alias("max"),
            )
        )
    return df.agg(*parts).select(rows_of(structs))


def _describe_texts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts by 128-bit hashes of the values; full values are compared only among candidates for the top one.

    A group of equal hashes is one value, so it carries the value's first characters along. The smallest of these among the
    most frequent values of a column is what the top value begins with; rows that begin so and whose hash is
    among the most frequent give the value by a minimum, which tasks take before anything moves.
    """
    texts = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    long = texts.unpivot([], list(columns), "column", "value").filter(F.col("value").isNotNull())
    hashed = long.withColumns(
        {"h1": F.xxhash64("value"), "h2": F.xxhash64(F.lit(1), "value"), "head": F.left("value", F.lit(_PREFIX))}
    )
    counts = hashed.groupBy("column", "h1", "h2").agg(
        F.count(F.lit(1)).alias("n"), F.min("head").alias("head"), F.min(F.length("value")).alias("length")
    )
    counts = written(counts, "text-counts")
    found = counts.groupBy("column").agg(
        F.sum("n").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        F.min(F.struct((-F.col("n")).alias("rank"), F.col("head"), F.col("length"))).alias("best"),
    )
    # One row a column.
    rows = found.collect()
    best = table(
        df.sparkSession,
        "column string, count bigint, unique bigint, freq bigint, head string, length int",
        [
            [r["column"], r["count"], r["unique"], -r["best"]["rank"], r["best"]["head"], r["best"]["length"]]
            for r in rows
        ],
    )
    # Values of up to the prefix's length are known already: they sort before all that go on.
    top = best.filter(F.col("length") <= _PREFIX).select("column", F.col("head").alias("top"))
    if any(r["best"]["length"] > _PREFIX for r in rows):
        longer = best.filter(F.col("length") > _PREFIX).select("column", "head", "freq")
        chosen = counts.join(F.broadcast(longer), ["column", "head"]).filter("n = freq").select("column", "h1", "h2")
        few = chosen.limit(_FEW_CANDIDATES + 1).count() <= _FEW_CANDIDATES
        begun = hashed.join(F.broadcast(longer), ["column", "head"], "left_semi")
        tops = begun.join(F.broadcast(chosen) if few else chosen, ["column", "h1", "h2"], "left_semi")
        top = top.unionByName(tops.groupBy("column").agg(F.min("value").alias("top")))
    # A column without any value has no counts: it comes in from the list of columns.
    named = table(df.sparkSession, "column string", [[c] for c in columns])
    empty = [F.lit(None).cast("double").alias(name) for name in _NUMBERS]
    return named.join(best, "column", "left").join(top, "column", "left").select(
        "column",
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
        F.coalesce("unique", F.lit(0)).cast("bigint").alias("unique"),
        "top",
        "freq",
        *empty,
    )


def describe_all(df: DataFrame) -> DataFrame:
    """One row per column: counts, quartiles and moments of numbers, top value of texts."""
    numbers, texts = roles(df)
    parts = []
    if numbers:
        parts.append(_describe_numbers(df, numbers))
    if texts:
        parts.append(_describe_texts(df, texts))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def missingness(df: DataFrame) -> DataFrame:
    """Columns with missing values, their number and percentage, most first."""
    blanks = [F.count_if(is_missing(df, c)).alias(f"blank_{i}") for i, c in enumerate(df.columns)]
    one_row = df.agg(F.count(F.lit(1)).alias("rows"), *blanks)
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"blank_{i}").alias("missing"),
            F.bround(F.col(f"blank_{i}") / F.col("rows") * 100, 2).alias("pct"),
        )
        for i, c in enumerate(df.columns)
    ]
    found = one_row.select(rows_of(structs)).filter("missing > 0")
    return found.orderBy(F.desc("missing"), "column")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Non-null values with count and share of all rows. The total re-uses the counts' shuffle."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    return (
        counts.filter(F.col("value").isNotNull())
        .withColumn("pct", F.bround(F.col("count") / total, 3))
        .orderBy(F.desc("count"), "value")
    )


def group_rate(df: DataFrame, by: str | Column, target: str, name: str = "value") -> DataFrame:
    """Mean and count of the target per key, highest rate first; rows without a key are left out."""
    key = F.col(by) if isinstance(by, str) else by
    return (
        df.select(key.alias(name), F.col(target).alias("_y"))
        .filter(F.col(name).isNotNull())
        .groupBy(name)
        .agg(F.avg("_y").alias("rate"), F.count("_y").alias("count"))
        .orderBy(F.desc("rate"), name)
    )


def group_rates(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Group rates of several keys from one scan, keys as text."""
    keyed = df.select(
        F.col(target).alias("_y"), *[F.col(c).cast("string").alias(c) for c in columns]
    )
    long = keyed.unpivot(["_y"], list(columns), "feature", "value")
    return (
        long.filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.avg("_y").alias("rate"), F.count("_y").alias("count"))
        .orderBy("feature", F.desc("rate"), "value")
    )


def binned_rate(
    df: DataFrame, column: str, target: str, edges: Sequence[float] = AGE_EDGES
) -> DataFrame:
    """Target mean per right-closed bin, lowest edge included; empty bins give null."""
    rates = (
        df.select(right_closed_bin(F.col(column), edges, True).alias("bin"), F.col(target).alias("_y"))
        .filter(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.avg("_y").alias("rate"))
    )
    labels = list(enumerate(bin_labels(edges, True)))
    bins = table(df.sparkSession, "place int, bin string", labels)
    return bins.join(rates, "bin", "left").select("place", "bin", "rate").orderBy("place")


def pivot_rate(
    df: DataFrame, index: str, columns: str, target: str, values: Sequence[str] | None = None
) -> DataFrame:
    """Target mean with ``index`` as rows and the values of ``columns`` as columns."""
    kept = df.filter(F.col(index).isNotNull() & F.col(columns).isNotNull())
    chosen = list(values) if values is not None else None
    return kept.groupBy(index).pivot(columns, chosen).agg(F.avg(target)).orderBy(index)


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair in one aggregate, over rows where both are known.

    An aggregate holds the square of the columns as expressions: more than a few go through blocks of sums.
    """
    if len(columns) > _FEW_COLUMNS:
        return moments.correlations(df, columns)
    pairs = list(combinations_with_replacement(columns, 2))
    found = df.agg(
        *[F.corr(known(F.col(a)), known(F.col(b))).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    )
    both = [(a, b, i) for i, (a, b) in enumerate(pairs)]
    both += [(b, a, i) for i, (a, b) in enumerate(pairs) if a != b]
    structs = [
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"r{i}").alias("corr"))
        for a, b, i in both
    ]
    return found.select(rows_of(structs))


def prevalence(df: DataFrame, target: str) -> DataFrame:
    """Mean of a 0/1 column and its rows."""
    return df.agg(F.avg(target).alias("prevalence"), F.count(target).alias("n"))


def positive_rate(df: DataFrame, by: str, label: str) -> DataFrame:
    """Share of rows labelled 1 per key; a missing label counts as not 1."""
    positive = F.coalesce(F.col(label) == 1, F.lit(False)).cast("double")
    return df.groupBy(by).agg(F.avg(positive).alias("pred_pos_rate"))


def shape(df: DataFrame, numeric: str = "numeric", text: str = "text") -> DataFrame:
    """Columns in order with role, and the table's rows and columns."""
    numbers, _ = roles(df)
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    structs = [
        F.struct(
            F.lit(i).alias("place"),
            F.lit(c).alias("column"),
            F.lit(numeric if c in numbers else text).alias("role"),
            F.lit(len(df.columns)).alias("n_columns"),
            F.col("n_rows"),
        )
        for i, c in enumerate(df.columns)
    ]
    return rows.select(rows_of(structs))


def dtypes(df: DataFrame) -> DataFrame:
    """Column names and Spark types."""
    return table(df.sparkSession, "column string, dtype string", df.dtypes)


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts in equal-width bins between the smallest and largest value, empty bins included.

    ``bins`` is for the caller to choose. The last bin holds the largest value.
    """
    values = df.select(known(F.col(column)).alias("x")).filter(F.col("x").isNotNull())
    ends = values.agg(F.struct(F.min("x").alias("low"), F.max("x").alias("high"))).scalar()
    width = (F.col("ends.high") - F.col("ends.low")) / bins
    place = F.least(
        F.lit(bins), F.coalesce(F.floor(F.try_divide(F.col("x") - F.col("ends.low"), width)), F.lit(0)) + 1
    )
    counts = (
        values.withColumn("ends", ends)
        .groupBy(place.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return (
        every.withColumn("ends", ends)
        .join(counts, "bin", "left")
        .select(
            "bin",
            (F.col("ends.low") + (F.col("bin") - 1) * width).alias("low"),
            (F.col("ends.low") + F.col("bin") * width).alias("high"),
            F.coalesce("count", F.lit(0)).alias("count"),
        )
        .orderBy("bin")
    )
