"""Exact ranks and exact cuts of a table in hash or value order, without a one-task sort."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldsafe.functions.numeric import hash_key
from foldsafe.operators.cells import CELL, NumericCells, hash_cell, hash_digits, ordinal
from foldsafe.sources.scratch import written

_CLASS = "_class"
_KEY = "_key"
_SUB = "_sub"
# Sorts after every hex digit, so values above a cell's lower edge come after the edge's own rows.
_PAST_EDGE = "z"
# Cuts of all classes together are broadcast up to this many, some 100 bytes each.
_FEW_CUTS = 100_000


def _with_keys(
    df: DataFrame,
    id_col: str,
    seed: int,
    class_col: str | None,
    order_col: str | None,
) -> DataFrame:
    """Add class, cell and a full order key: (value order, then hash) or hash alone."""
    digits = hash_digits(df.sparkSession)
    mixed = hash_key(F.col(id_col), seed)
    group = F.col(class_col) if class_col else F.lit(0)
    if order_col is None:
        return df.withColumns(
            {
                _CLASS: group,
                CELL: F.lit(0),
                _SUB: hash_cell(mixed, digits),
                _KEY: F.struct(mixed.alias("h"), F.col(id_col).alias("i")),
            }
        )
    # Many rows may share one time: such a value becomes a cell edge, and its rows are spread
    # over sub-cells by hash. Ties are therefore in hash order.
    value, exact = ordinal(F.col(order_col), df.schema[order_col].dataType)
    cells = NumericCells.learn(df, value)
    numbered = cells.add(df, value)
    sub = F.when(exact & cells.at_edge(value), hash_cell(mixed, digits)).otherwise(F.lit(_PAST_EDGE))
    return numbered.withColumns(
        {
            _CLASS: group,
            _SUB: sub,
            _KEY: F.struct(
                F.col(order_col).alias("v"), mixed.alias("h"), F.col(id_col).alias("i")
            ),
        }
    )


def _cell_starts(keyed: DataFrame, classes: bool) -> DataFrame:
    """Rows per cell with the position each cell starts at, within its class and overall.

    Cells are added up within their class, so those of one class meet in a task: their number is set by the
    cells' digits, not by the rows. Of all classes only the totals meet, one row each.
    """
    counts = keyed.groupBy(_CLASS, CELL, _SUB).agg(F.count(F.lit(1)).alias("rows"))
    own_class = Window.partitionBy(_CLASS)
    placed = counts.withColumns(
        {
            "start": F.sum("rows").over(own_class.orderBy(CELL, _SUB)) - F.col("rows"),
            "class_rows": F.sum("rows").over(own_class),
        }
    )
    if not classes:
        starts = placed.withColumn("class_first", F.lit(0).cast("bigint"))
    else:
        totals = counts.groupBy(_CLASS).agg(F.sum("rows").alias("all"))
        earlier = F.sum("all").over(Window.orderBy(_CLASS)) - F.col("all")
        starts = _matched(placed, totals.select(_CLASS, earlier.alias("class_first")), [_CLASS])
    return starts.withColumn("first", F.col("class_first") + F.col("start"))


def _matched(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys in which null equals null."""
    renamed = {k: f"_matched{k}" for k in keys}
    same = [F.col(k).eqNullSafe(F.col(new)) for k, new in renamed.items()]
    return rows.join(table.withColumnsRenamed(renamed), same, how).drop(*renamed.values())


def global_rank(
    df: DataFrame,
    id_col: str,
    seed: int = 42,
    class_col: str | None = None,
    order_col: str | None = None,
    name: str = "rank",
) -> DataFrame:
    """Add the exact 0-based position of every row in (class, value, hash) order, nulls first.

    Cost: one narrow aggregate and one shuffle of the rows by cell. The offsets join uses the same
    key as the window, so Spark shuffles the rows once for both.
    """
    keyed = _with_keys(df, id_col, seed, class_col, order_col)
    starts = _cell_starts(keyed, class_col is not None).select(_CLASS, CELL, _SUB, "first")
    inside = Window.partitionBy(_CLASS, CELL, _SUB).orderBy(_KEY)
    return (
        _matched(keyed, starts, [_CLASS, CELL, _SUB])
        .withColumn(name, F.col("first") + F.row_number().over(inside) - 1)
        .drop(_CLASS, CELL, _SUB, _KEY, "first")
    )


def places(df: DataFrame, by: Sequence[str], order: str, name: str = "place") -> DataFrame:
    """Add the exact 0-based position of every row within its group, in value order.

    The rows are sorted over all tasks by group and value; counts per task and group give the offsets,
    so a group of any size is spread over many tasks. Keys must not be null.
    """
    ordered = written(
        df.sort(*by, order).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}),
        "places",
    )
    # One row per task and group that meet.
    parts = ordered.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    earlier = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")
    offsets = parts.withColumn("_before", earlier).drop("_n")
    found = ordered.join(offsets, ["_part", *by])
    return found.withColumn(name, F.col("_row") - F.col("_first") + F.col("_before")).drop(
        "_part", "_row", "_first", "_before"
    )


def with_row_id(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """Number the rows of a table without an id, 0-based, in the order of the given columns.

    Rows that agree in those columns follow a hash of the whole row; only rows that are equal in every
    column may swap numbers, which changes nothing. The rows are sorted over all tasks.
    """
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    ordered = written(
        df.sort(*order, whole).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}),
        "row-ids",
    )
    # One row per task.
    parts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    offsets = parts.select("_part", "_first", before.alias("_before"))
    numbered = ordered.join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_row") - F.col("_first") + F.col("_before")).select(*df.columns, name)


def cut_blocks(
    df: DataFrame,
    id_col: str,
    n_cuts: int,
    position: Callable[[Column, Column, Column], Column],
    seed: int = 42,
    class_col: str | None = None,
    order_col: str | None = None,
    name: str = "block",
    n_classes: int = 1,
) -> DataFrame:
    """Add the number of the consecutive block each row falls in, 0 to ``n_cuts``.

    ``position(i, rows, first)`` gives the place, within a class of ``rows`` rows whose first row
    is the ``first``-th overall, at which block ``i`` (1 to ``n_cuts``) starts. ``n_classes`` is their counted
    number: the cuts of a few are broadcast, those of more are joined.

    Only the rows in the few cells that hold a cut are sorted; they yield the exact key at each
    cut. Every row then compares its own key with those, so the wide table is never shuffled.
    """
    keyed = _with_keys(df, id_col, seed, class_col, order_col)
    numbers = F.sequence(F.lit(1).cast("bigint"), F.lit(n_cuts).cast("bigint"))
    places = F.transform(
        numbers, lambda i: position(i, F.col("class_rows"), F.col("class_first")).cast("bigint")
    )
    small = F.broadcast if n_classes * n_cuts <= _FEW_CUTS else (lambda table: table)
    holding = (
        _cell_starts(keyed, class_col is not None)
        .withColumn(
            "places",
            F.filter(
                places,
                lambda p: (p >= F.col("start")) & (p < F.col("start") + F.col("rows")),
            ),
        )
        .filter(F.size("places") > 0)
        .select(_CLASS, CELL, _SUB, "start", "places")
    )
    inside = Window.partitionBy(_CLASS, CELL, _SUB).orderBy(_KEY)
    # At most n_cuts cells per class, whatever the number of rows.
    at_cuts = (
        _matched(keyed.select(_CLASS, CELL, _SUB, _KEY), small(holding), [_CLASS, CELL, _SUB])
        .withColumn("place", F.col("start") + F.row_number().over(inside) - 1)
        .filter(F.array_contains("places", F.col("place")))
        # Empty blocks share one place: keep each copy, so later blocks keep their number.
        .withColumn("place", F.explode(F.filter("places", lambda p: p == F.col("place"))))
    )
    per_class = at_cuts.groupBy(_CLASS).agg(F.sort_array(F.collect_list(_KEY)).alias("_cuts"))
    own = F.col(_KEY)
    passed = F.size(F.filter(F.coalesce("_cuts", F.array()), lambda cut: cut <= own))
    return (
        _matched(keyed, small(per_class), [_CLASS], "left")
        .withColumn(name, passed)
        .drop(_CLASS, CELL, _SUB, _KEY, "_cuts")
    )


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    cell: str,
    order: Sequence[str],
    values: Sequence[str],
) -> DataFrame:
    """Add ``<value>_before``: the total of earlier rows within each group, in two levels.

    ``df`` needs one row per distinct key (pre-aggregated) and a cell in key order, so that a
    group of any size is spread over its cells.
    """
    keys = [*by, cell]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by, F.lit(0)).orderBy(cell).rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = df.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
    offsets = totals.select(
        *keys, *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}_cell") for v in values]
    )
    summed = {
        f"{v}_before": F.col(f"_{v}_cell") + F.coalesce(F.sum(v).over(inside), F.lit(0))
        for v in values
    }
    return (
        df.join(offsets, keys)
        .withColumns(summed)
        .drop(*[f"_{v}_cell" for v in values])
    )


def head(df: DataFrame, order: Sequence[str], rows: int = 5) -> DataFrame:
    """First rows in a stated order, with their place; Spark keeps ``rows`` per task, no full sort."""
    top = df.orderBy(*order).limit(rows)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))
