"""Pearson correlations of many columns from blocks of pairwise sums.

Columns are cut into blocks of `BLOCK`. A pass takes up to `PAIRS` pairs of blocks; every task adds up, per pair, five
matrices over the rows where both columns are known: rows, sums of either column, products, and squares of either.
That is at most `PAIRS` x 6 x `BLOCK`^2 doubles in a task, whatever the number of columns or rows. Columns are
centred at their overall means first, so that large means cancel nothing. Only those sums are shuffled, through a
tree of small groups, and each pair's correlations are made where its sum ends up; the driver holds two numbers a column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsafe.functions.numeric import known
from foldsafe.operators import partials
from foldsafe.sources.scratch import written

BLOCK = 256
PAIRS = 16
_SUMS = 6
_RESULT = "column_a string, column_b string, corr double"


def correlations(df: DataFrame, columns: Sequence[str], block: int = BLOCK, pairs: int = PAIRS) -> DataFrame:
    """``(column_a, column_b, corr)`` of every ordered pair, over rows where both are known.

    Null where fewer than two rows know both, or where one column does not vary in them. Columns that hold
    an infinite value have no correlations.
    """
    names = list(columns)
    if not names:
        return df.sparkSession.createDataFrame([], _RESULT)
    # The numbers alone, read once for the means and once a pass for the products.
    numbers = df.select(F.array(*[known(F.col(f"`{c}`")).cast("double") for c in names]).alias("x"))
    rows = written(numbers, "moments")
    parts = rows.rdd.getNumPartitions()
    means = _means(rows, len(names), parts)
    blocks = [(at, min(at + block, len(names))) for at in range(0, len(names), block)]
    every = list(combinations_with_replacement(blocks, 2))
    passes = [every[at: at + pairs] for at in range(0, len(every), pairs)]
    return reduce(DataFrame.unionByName, [_passed(rows, parts, names, means, chosen) for chosen in passes])


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            yield values.reshape(batch.num_rows, width)


def _means(rows: DataFrame, width: int, parts: int) -> np.ndarray:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width))
        for x in _matrices(batches, width):
            total += np.array((np.nansum(x, 0), (~np.isnan(x)).sum(0)))
        yield _part(total)

    found = partials.collected(rows.mapInArrow(task, _schema()), parts)
    total = np.zeros((2, width)) if found is None else found.reshape(2, width)
    means = total[0] / np.maximum(total[1], 1)
    return np.where(np.isfinite(means), means, 0.0)


def _schema(*keys: str) -> str:
    return ", ".join([*keys, f"{partials.PART} long", f"{partials.BODY} binary"])


def _part(total: np.ndarray, **keys: int) -> pa.RecordBatch:
    columns = {k: pa.array([v], pa.int32()) for k, v in keys.items()}
    columns[partials.PART] = pa.array([TaskContext.get().partitionId()], pa.int64())
    columns[partials.BODY] = pa.array([total.astype("<f8").tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _passed(
    rows: DataFrame, parts: int, names: list[str], means: np.ndarray, chosen: list[tuple[tuple[int, int], tuple[int, int]]]
) -> DataFrame:
    """Correlations of some pairs of blocks, from one pass."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((_SUMS, b1 - b0, c1 - c0)) for (b0, b1), (c0, c1) in chosen]
        for x in _matrices(batches, len(names)):
            there = ~np.isnan(x)
            x = np.where(there, x - means, 0.0)
            there = there.astype(np.float64)
            for total, ((b0, b1), (c0, c1)) in zip(totals, chosen):
                a, b, has_a, has_b = x[:, b0:b1], x[:, c0:c1], there[:, b0:b1], there[:, c0:c1]
                for place, (left, right) in enumerate(
                    ((has_a, has_b), (a, has_b), (has_a, b), (a, b), (a * a, has_b), (has_a, b * b))
                ):
                    total[place] += left.T @ right
        for pair, total in enumerate(totals):
            yield _part(total, pair=pair)

    def finish(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column(partials.PART).to_numpy(), kind="stable")
        (b0, b1), (c0, c1) = chosen[table.column("pair")[0].as_py()]
        total = sum(partials.array_of(table.column(partials.BODY)[int(i)].as_buffer()) for i in order)
        r = _coefficients(total.reshape(_SUMS, b1 - b0, c1 - c0))
        first, second = np.meshgrid(np.arange(b0, b1), np.arange(c0, c1), indexing="ij")
        first, second, r = first.ravel(), second.ravel(), r.ravel()
        if b0 != c0:
            first, second, r = np.append(first, second), np.append(second, first), np.append(r, r)
        labels = pa.array(names, pa.string())
        return pa.table(
            {
                "column_a": labels.take(pa.array(first)),
                "column_b": labels.take(pa.array(second)),
                "corr": pa.array(r, pa.float64(), mask=np.isnan(r)),
            }
        )

    summed = partials.summed(rows.mapInArrow(task, _schema("pair int")), ["pair"], parts, partials.FAN_IN)
    return summed.groupBy("pair").applyInArrow(finish, _RESULT)


def _coefficients(total: np.ndarray) -> np.ndarray:
    """Correlations, NaN where there is none."""
    n, a, b, both, aa, bb = total
    with np.errstate(all="ignore"):
        spread_a, spread_b = aa - a * a / n, bb - b * b / n
        # What rounding leaves of a column that does not vary is no spread.
        flat = (spread_a <= 1e-14 * aa) | (spread_b <= 1e-14 * bb) | (n < 2)
        r = np.where(flat, np.nan, (both - a * b / n) / np.sqrt(spread_a * spread_b))
    return np.clip(r, -1.0, 1.0)
