"""Statistics that each fold may use: learnt from its training folds, for all folds at once.

Rows are never copied per fold. A table of per-fold moments or counts is made in one pass, and the
statistic of a holdout is put together from the folds it is trained on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldsafe.errors import SchemaError
from foldsafe.functions.numeric import known
from foldsafe.functions.text import null_as_text
from foldsafe.operators import quantiles
from foldsafe.operators.joins import lookup
from foldsafe.operators.small import rows_of, table
from foldsafe.operators.splits import FOLD, training_folds, trains_on

_EPSILON = 2.220446049250313e-16
CONSTANT_NUMBER = 0.0
CONSTANT_TEXT = "missing_value"


def _per_holdout(by_fold: DataFrame, n_splits: int, scheme: str) -> DataFrame:
    """Copy each fold's summary to the holdouts that are trained on it (folds x holdouts rows)."""
    holdouts = F.array(*[F.lit(h) for h in range(n_splits)])
    return by_fold.withColumn("holdout", F.explode(holdouts)).filter(
        trains_on(scheme, F.col(FOLD), F.col("holdout"))
    )


def _fold_moments(folded: DataFrame, columns: Sequence[str]) -> DataFrame:
    parts = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        value = known(F.col(c))
        parts += [
            F.count(value).alias(f"n_{i}"),
            F.avg(value).alias(f"mean_{i}"),
            F.var_pop(value).alias(f"var_{i}"),
        ]
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            F.col("rows"),
            F.col(f"n_{i}").alias("n"),
            F.coalesce(f"mean_{i}", F.lit(0.0)).alias("mean"),
            F.coalesce(F.col(f"var_{i}") * F.col(f"n_{i}"), F.lit(0.0)).alias("m2"),
        )
        for i, c in enumerate(columns)
    ]
    return folded.groupBy(FOLD).agg(*parts).select(FOLD, rows_of(structs))


def _add_up(parts: Column, of: str) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda total, p: total + p[of])


def numeric_moments(
    folded: DataFrame, columns: Sequence[str], n_splits: int, scheme: str
) -> DataFrame:
    """``(holdout, column, rows, n, mean, m2)`` of the training folds, merged without cancellation."""
    merged = (
        _per_holdout(_fold_moments(folded, columns), n_splits, scheme)
        .groupBy("holdout", "column")
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("n").alias("n"),
            F.collect_list(
                F.struct("n", "mean", "m2", (F.col("n") * F.col("mean")).alias("sum"))
            ).alias("parts"),
        )
        .withColumn("mean", F.try_divide(_add_up(F.col("parts"), "sum"), F.col("n")))
    )
    centre = F.coalesce("mean", F.lit(0.0))
    spread = F.aggregate(
        "parts",
        F.lit(0.0),
        lambda total, p: total + p["m2"] + p["n"] * F.pow(p["mean"] - centre, F.lit(2.0)),
    )
    return merged.select("holdout", "column", "rows", "n", "mean", spread.alias("m2"))


def medians(
    folded: DataFrame,
    columns: Sequence[str],
    n_splits: int,
    scheme: str,
    small_rows: int = quantiles.SMALL_ROWS,
) -> DataFrame:
    """``(holdout, column, fill)`` with exact medians of the training folds.

    Up to a checked number of rows, values are counted once per fold and the medians of all holdouts
    taken from those counts. Larger columns are narrowed in on, which shuffles no values at all.
    """
    sizes = quantiles.counts(folded, {c: F.col(c) for c in columns})
    small = [c for c in columns if sizes[c] <= small_rows]
    large = [c for c in columns if sizes[c] > small_rows]
    parts = []
    if small:
        parts.append(_medians_from_counts(folded, small, n_splits, scheme))
    if large:
        parts.append(_medians_narrowed(folded, large, n_splits, scheme))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _medians_from_counts(
    folded: DataFrame, columns: Sequence[str], n_splits: int, scheme: str
) -> DataFrame:
    """Middle values by running counts over the sorted distinct values of each column."""
    counts = _counts_by_fold(folded, columns, n_splits, "double")
    upward = Window.partitionBy("column").orderBy("level")
    whole = Window.partitionBy("column")
    used = {f"u{h}": _training_rows(n_splits, scheme, h) for h in range(n_splits)}
    summed = counts.select("column", "level", *[c.alias(n) for n, c in used.items()])
    running = {f"r{h}": F.sum(f"u{h}").over(upward) for h in range(n_splits)}
    totals = {f"t{h}": F.sum(f"u{h}").over(whole) for h in range(n_splits)}
    placed = summed.withColumns(running).withColumns(totals)

    def value_at(h: int, place: Column) -> Column:
        return F.min(F.when(F.col(f"r{h}") > place, F.col("level")))

    structs = []
    for h in range(n_splits):
        rows = F.col(f"t{h}")
        low, high = value_at(h, F.floor((rows - 1) / 2)), value_at(h, F.floor(rows / 2))
        structs.append(F.struct(F.lit(h).alias("holdout"), ((low + high) / 2).alias("fill")))
    found = placed.groupBy("column").agg(F.array(*structs).alias("fills"))
    return found.select("column", F.inline("fills")).select("holdout", "column", "fill")


def _unions(n_splits: int, scheme: str) -> dict[int, list[int]]:
    return {h: training_folds(scheme, n_splits, h) for h in range(n_splits)}


def _medians_narrowed(folded: DataFrame, columns: Sequence[str], n_splits: int, scheme: str) -> DataFrame:
    series = {c: F.col(c) for c in columns}
    found = quantiles.by_group(folded, F.col(FOLD), series, _unions(n_splits, scheme), [0.5])
    rows = [(h, c, ends[0] if ends else None) for (h, c), ends in found.items()]
    return table(folded.sparkSession, "holdout int, column string, fill double", rows)


def _training_rows(n_splits: int, scheme: str, holdout: int) -> Column:
    """Rows of a holdout's training folds, from the columns of `_counts_by_fold`."""
    used = [
        F.when(trains_on(scheme, F.lit(f), holdout), F.col(f"n{f + 1}")).otherwise(0)
        for f in range(-1, n_splits)
    ]
    return sum(used, F.lit(0).cast("bigint"))


def _counts_by_fold(
    folded: DataFrame, columns: Sequence[str], n_splits: int, kind: str
) -> DataFrame:
    """``(column, level, n0, n1, …)``: rows per non-null value in fold -1, 0, … from one scan."""
    if kind == "double":
        values = folded.select(FOLD, *[known(F.col(c)).alias(c) for c in columns])
    else:
        values = folded.select(FOLD, *[F.col(c).cast(kind).alias(c) for c in columns])
    long = values.unpivot([FOLD], list(columns), "column", "level").filter("level IS NOT NULL")
    return long.groupBy("column", "level").agg(
        *[F.count_if(F.col(FOLD) == f).alias(f"n{f + 1}") for f in range(-1, n_splits)]
    )


def level_counts(
    folded: DataFrame, columns: Sequence[str], n_splits: int, scheme: str, kind: str = "string"
) -> DataFrame:
    """``(holdout, column, level, n)``: training rows per non-null value, only values that occur.

    One scan counts values per fold; the copies per holdout are of distinct values, not of rows.
    """
    copies = [
        F.struct(F.lit(h).alias("holdout"), _training_rows(n_splits, scheme, h).alias("n"))
        for h in range(n_splits)
    ]
    return (
        _counts_by_fold(folded, columns, n_splits, kind)
        .select("column", "level", rows_of(copies))
        .filter("n > 0")
        .select("holdout", "column", "level", "n")
    )


def modes(counts: DataFrame) -> DataFrame:
    """``(holdout, column, fill)`` with the most frequent level, the smallest among equals."""
    best = F.min(F.struct((-F.col("n")).alias("rank"), F.col("level")))
    return counts.groupBy("holdout", "column").agg(best["level"].alias("fill"))


def numeric_stats(
    folded: DataFrame,
    columns: Sequence[str],
    n_splits: int,
    strategy: str = "median",
    scheme: str = "stratified",
) -> DataFrame:
    """``(holdout, column, rows, n, fill, mean, sd)``: imputation value, then the mean and
    population deviation of the imputed training values; a constant column has deviation 1.

    The moments of imputed values follow from the moments of known values and the blank count, so
    no second pass over the rows is needed.
    """
    moments = numeric_moments(folded, columns, n_splits, scheme)
    keys = ["holdout", "column"]
    if strategy == "median":
        filled = moments.join(medians(folded, columns, n_splits, scheme), keys, "left")
    elif strategy == "mean":
        filled = moments.withColumn("fill", F.col("mean"))
    elif strategy == "most_frequent":
        common = modes(level_counts(folded, columns, n_splits, scheme, "double"))
        filled = moments.join(common, keys, "left")
    else:
        filled = moments.withColumn("fill", F.lit(CONSTANT_NUMBER))
    # A column without a single training value is filled with a constant: it then says nothing.
    filled = filled.withColumn("fill", F.coalesce("fill", F.lit(CONSTANT_NUMBER)))
    n, rows, mean, fill = (F.col(c) for c in ("n", "rows", "mean", "fill"))
    known_mean = F.coalesce(mean, F.lit(0.0))
    blanks = rows - n
    centre = (n * known_mean + blanks * fill) / rows
    spread = (
        F.col("m2")
        + n * F.pow(known_mean - centre, F.lit(2.0))
        + blanks * F.pow(fill - centre, F.lit(2.0))
    )
    return filled.select(
        *keys, "rows", "n", "fill", centre.alias("mean"), safe_deviation(spread / rows, centre, rows).alias("sd")
    )


def safe_deviation(variance: Column, mean: Column, rows: Column) -> Column:
    """Square root of a variance, 1 where the variance is only rounding error."""
    noise = rows * _EPSILON * variance + F.pow(rows * mean * _EPSILON, F.lit(2.0))
    return F.when(variance <= noise, F.lit(1.0)).otherwise(F.sqrt(variance))


def impute_scale(
    folded: DataFrame, columns: Sequence[str], stats: DataFrame, scale: bool = True
) -> DataFrame:
    """Fill and standardise each row with the statistics of its own fold.

    One row of statistics per fold is broadcast: its size is folds x columns.
    """
    wide = stats.groupBy("holdout").agg(
        *[
            F.max(F.when(F.col("column") == c, F.col(part))).alias(f"_{part}_{i}")
            for i, c in enumerate(columns)
            for part in ("fill", "mean", "sd")
        ]
    )
    joined = folded.join(F.broadcast(wide), F.col(FOLD) == F.col("holdout"), "left")
    made = {}
    for i, c in enumerate(columns):
        value = F.coalesce(known(F.col(c)), F.col(f"_fill_{i}"))
        made[c] = (value - F.col(f"_mean_{i}")) / F.col(f"_sd_{i}") if scale else value
    return joined.withColumns(made).select(folded.columns)


def clip_limits(
    folded: DataFrame,
    columns: Sequence[str],
    n_splits: int,
    scheme: str = "stratified",
    low: float = 0.01,
    high: float = 0.99,
    small_rows: int = quantiles.SMALL_ROWS,
) -> DataFrame:
    """``(holdout, column, low, high)``: exact interpolated quantiles of the finite training values, for all holdouts at once.

    A column without a finite training value has null limits.
    """
    if not 0 <= low <= high <= 1:
        raise SchemaError("quantiles lie between 0 and 1, the lower one first")
    finite = {}
    for c in columns:
        value = known(F.col(f"`{c}`"))
        finite[c] = F.when(F.abs(value) < float("inf"), value)
    sizes = quantiles.counts(folded, finite)
    large = {c: v for c, v in finite.items() if sizes[c] > small_rows}
    parts = []
    if large:
        found = quantiles.by_group(folded, F.col(FOLD), large, _unions(n_splits, scheme), [low, high])
        rows = [(h, c, *(ends or (None, None))) for (h, c), ends in found.items()]
        parts.append(table(folded.sparkSession, "holdout int, column string, low double, high double", rows))
    if len(large) < len(finite):
        parts.append(_small_limits(folded, {c: v for c, v in finite.items() if c not in large}, n_splits, scheme, low, high))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _small_limits(
    folded: DataFrame, values: dict[str, Column], n_splits: int, scheme: str, low: float, high: float
) -> DataFrame:
    named = [(h, c) for h in range(n_splits) for c in values]
    one_row = folded.agg(*[
        F.percentile(F.when(trains_on(scheme, F.col(FOLD), h), values[c]), [float(low), float(high)]).alias(f"e{i}")
        for i, (h, c) in enumerate(named)
    ])
    structs = [
        F.struct(
            F.lit(h).alias("holdout"), F.lit(c).alias("column"),
            F.get(F.col(f"e{i}"), F.lit(0)).alias("low"), F.get(F.col(f"e{i}"), F.lit(1)).alias("high"),
        )
        for i, (h, c) in enumerate(named)
    ]
    return one_row.select(rows_of(structs))


def winsorise(folded: DataFrame, columns: Sequence[str], limits: DataFrame) -> DataFrame:
    """Each row's values drawn in to its own fold's limits; rows that are never held out stay as they are.

    Infinite values become the limit on their side, blanks stay blank (not-a-number becomes null). One row of limits per fold is
    broadcast: its size is folds x columns.
    """
    wide = limits.groupBy("holdout").agg(*[
        F.max(F.when(F.col("column") == c, F.col(end))).alias(f"_{end}_{i}")
        for i, c in enumerate(columns) for end in ("low", "high")
    ])
    joined = folded.join(F.broadcast(wide), F.col(FOLD) == F.col("holdout"), "left")
    made = {}
    for i, c in enumerate(columns):
        value, low, high = known(F.col(f"`{c}`")), F.col(f"_low_{i}"), F.col(f"_high_{i}")
        made[c] = F.when(value < low, low).when(value > high, high).otherwise(value)
    return joined.withColumns(made).select(folded.columns)


def one_hot(
    folded: DataFrame,
    id_col: str,
    columns: Sequence[str],
    n_splits: int,
    strategy: str = "most_frequent",
    scheme: str = "stratified",
) -> DataFrame:
    """Long one-hot rows ``(id, column, level, hot)``: ``hot`` is 0 for a level not seen in training.

    Levels come as rows, so their number has no bound to respect.
    """
    if strategy == "constant":
        folded = folded.withColumns(
            {c: F.coalesce(F.col(c).cast("string"), F.lit(CONSTANT_TEXT)) for c in columns}
        )
    counts = level_counts(folded, columns, n_splits, scheme)
    holdouts = folded.filter(F.col(FOLD) >= 0)
    texts = holdouts.select(id_col, FOLD, *[F.col(c).cast("string").alias(c) for c in columns])
    long = texts.unpivot([id_col, FOLD], list(columns), "column", "level")
    if strategy == "most_frequent":
        fills = modes(counts).withColumnsRenamed({"holdout": FOLD})
        # Folds x columns rows.
        long = long.join(F.broadcast(fills), [FOLD, "column"], "left")
        long = long.withColumn("level", F.coalesce("level", "fill")).drop("fill")
    # Levels are matched per fold and column: the three parts make one key.
    seen = counts.select(_level_key("holdout").alias("_key"), F.col("n").alias("_seen"))
    found = lookup(long, _level_key(FOLD), seen, "_key", ["_seen"], "_seen")
    return found.select(
        id_col,
        FOLD,
        "column",
        null_as_text(F.col("level")).alias("level"),
        F.col("_seen").isNotNull().cast("int").alias("hot"),
    )


def _level_key(fold: str) -> Column:
    return F.concat_ws("|", F.col(fold), F.col("column"), F.concat(F.lit("="), F.col("level")))
