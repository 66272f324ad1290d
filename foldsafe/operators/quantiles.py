"""Exact quantiles and order statistics at any size.

Spark's ``percentile`` is exact but keeps every distinct value of a column in one task. It is used
up to a checked number of rows. Beyond that the answer is closed in on by the digits of its binary form, which sort like
the numbers: each pass counts rows per value of the next digits below those already known, by group of rows, so every set of groups
(the training folds of a holdout, say) has its answer from the same counts. Three passes do for most columns, five for any.
What is shuffled or collected is bounded by digits, columns and targets, not by rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsafe.functions.numeric import known

# Rows up to which a column's distinct values may sit in one aggregate buffer, and up to which the
# last few candidates of a narrowed range are told apart in one pass.
SMALL_ROWS = 500_000
SETTLE_ROWS = 50_000
_BITS = 64
# Sign, exponent and a little of the fraction first: numbers of one column share most of these.
_FIRST_BITS = 16
# Values of the next digits that a pass tells apart, a power of two.
_ACCURACY = 1 << 12
# Values of all columns that a task sorts at a time.
_CHUNK_VALUES = 1 << 21
_FOUND = "series int, prefix long, digit long, part int, n long, low long, high long"


@dataclass
class _Target:
    """The value at ``place`` (0-based, ascending) of one series among the rows of some groups.

    The first ``known`` bits of its key are ``prefix``; ``below`` rows of these groups have smaller keys.
    """

    series: int
    parts: frozenset[int]
    place: int
    prefix: int = 0
    below: int = 0
    inside: int | None = None
    answer: float | None = None

    def narrow(self, digits: Sequence[tuple], bits: int) -> None:
        """Use rows per digit (ascending ``(digit, rows by group, lowest key, highest key)``) to answer or go on."""
        left = self.place - self.below
        for digit, by_part, low, high in digits:
            rows = sum(n for part, n in by_part if part in self.parts)
            if left < rows:
                self.prefix = self.prefix << bits | digit
                self.inside = sum(n for _, n in by_part)
                if low == high:
                    self.answer = _number(low)
                return
            left -= rows
            self.below += rows
        raise IndexError(f"there is no row at place {self.place}")


def _keys(values: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in the order of the values."""
    bits = values.astype("<f8", copy=False).view(np.int64)
    ordered = bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))
    return ordered.view(np.uint64) ^ np.uint64(1 << 63)


def _number(key: int) -> float:
    """The value of a key."""
    bits = np.array([key], np.uint64) ^ np.uint64(1 << 63)
    signed = bits.view(np.int64)
    return float((signed ^ ((signed >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view("<f8")[0])


def _digit_counts(df: DataFrame, prefixes: dict[int, list[int]], done: int, bits: int) -> DataFrame:
    """Rows per (series, prefix, next digit, group) of a table of a group and one column per series, with the least and greatest key."""
    rest = _BITS - done - bits
    size = max(1, _CHUNK_VALUES // max(len(df.columns) - 1, 1))

    def found(columns: list[np.ndarray], part: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i, wanted in prefixes.items():
            usable = ~np.isnan(columns[i])
            keys, owner = _keys(columns[i][usable]), part[usable]
            out = []
            for p in np.unique(owner).tolist():
                own = np.sort(keys[owner == p])
                for prefix in wanted:
                    first, last = prefix << (_BITS - done), ((prefix + 1) << (_BITS - done)) - 1
                    some = own[np.searchsorted(own, np.uint64(first)): np.searchsorted(own, np.uint64(last), "right")]
                    if not len(some):
                        continue
                    digit = (some >> np.uint64(rest)) & np.uint64((1 << bits) - 1)
                    starts = np.flatnonzero(np.concatenate(([True], digit[1:] != digit[:-1])))
                    ends = np.append(starts[1:], len(some))
                    out.append((prefix, p, digit[starts], ends - starts, some[starts], some[ends - 1]))
            if out:
                n = [len(o[2]) for o in out]
                whole = np.array([o[0] for o in out], np.uint64).view(np.int64)
                bodies = [np.concatenate([o[k] for o in out]) for k in (2, 3, 4, 5)]
                signed = [(b ^ np.uint64(1 << 63)).view(np.int64) for b in bodies[2:]]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(sum(n), i, np.int32)), pa.array(np.repeat(whole, n)), pa.array(bodies[0].view(np.int64)),
                    pa.array(np.repeat(np.array([o[1] for o in out], np.int32), n)), pa.array(bodies[1].astype(np.int64)),
                    *[pa.array(x) for x in signed],
                ], names=["series", "prefix", "digit", "part", "n", "low", "high"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= size:
                yield from found(*_columns(held))
                held = []
        if held:
            yield from found(*_columns(held))

    one = df.mapInArrow(task, _FOUND)
    return one.groupBy("series", "prefix", "digit", "part").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def _columns(batches: list[pa.RecordBatch]) -> tuple[list[np.ndarray], np.ndarray]:
    """The series of some batches, blanks as NaN, and the rows' groups."""
    table = pa.Table.from_batches(batches)
    series = [table.column(i).to_numpy() for i in range(1, table.num_columns)]
    return series, table.column(0).to_numpy()


def _placed(df: DataFrame, targets: list[_Target], settle_rows: int) -> None:
    """Answer all targets on a table of a group (int) and a double per series, one pass per digit."""
    done = 0
    while open_targets := [t for t in targets if t.answer is None]:
        bits = max(1, _ACCURACY.bit_length() - 1) if done else _FIRST_BITS
        if all(t.inside is not None and t.inside <= settle_rows for t in open_targets):
            bits = _BITS - done
        bits = min(bits, _BITS - done)
        prefixes: dict[int, list[int]] = {}
        for t in open_targets:
            if t.prefix not in prefixes.setdefault(t.series, []):
                prefixes[t.series].append(t.prefix)
        seen: dict[tuple[int, int], dict[int, list]] = {}
        for r in _digit_counts(df, prefixes, done, bits).toArrow().to_pylist():
            digits = seen.setdefault((r["series"], r["prefix"] % 2**64), {})
            cell = digits.setdefault(r["digit"] % 2**64, [[], r["low"], r["high"]])
            cell[0].append((r["part"], r["n"]))
            cell[1], cell[2] = min(cell[1], r["low"]), max(cell[2], r["high"])
        ordered = {k: [(d, *digits[d]) for d in sorted(digits)] for k, digits in seen.items()}
        done += bits
        for t in open_targets:
            t.narrow([(d, by, lo + 2**63, hi + 2**63) for d, by, lo, hi in ordered.get((t.series, t.prefix), [])], bits)


def counts(df: DataFrame, series: dict[str, Column]) -> dict[str, int]:
    """Non-missing values of each series, from one aggregate."""
    found = df.agg(*[F.count(known(c)).alias(f"n{i}") for i, c in enumerate(series.values())]).first()
    return dict(zip(series, found))


def select(
    df: DataFrame,
    series: dict[str, Column],
    places: Iterable[tuple[str, int]],
    settle_rows: int = SETTLE_ROWS,
) -> dict[tuple[str, int], float]:
    """Exact values at 0-based ascending places of each series."""
    number = {name: i for i, name in enumerate(series)}
    targets = {(name, place): _Target(number[name], frozenset((0,)), place) for name, place in places}
    columns = [known(c).alias(f"v{i}") for i, c in enumerate(series.values())]
    _placed(df.select(F.lit(0).alias("part"), *columns), list(targets.values()), settle_rows)
    return {key: t.answer for key, t in targets.items()}


def _spots(probabilities: Sequence[float], size: int) -> list[tuple[int, int, float]]:
    spots = [p * (size - 1) for p in probabilities]
    return [(math.floor(s), math.ceil(s), s - math.floor(s)) for s in spots]


def by_group(
    df: DataFrame,
    part: Column,
    series: dict[str, Column],
    unions: Mapping[int, Iterable[int]],
    probabilities: Sequence[float],
) -> dict[tuple[int, str], list[float] | None]:
    """Linear-interpolated quantiles of each series over the rows of each union of groups, by (union, series).

    ``part`` numbers a row's group; rows without one count nowhere. A series without a value there has none.
    Each row is counted once, however many unions it belongs to.
    """
    named = list(series)
    columns = [known(c).alias(f"v{i}") for i, c in enumerate(series.values())]
    slim = df.select(part.cast("int").alias("part"), *columns).filter("part IS NOT NULL")
    sizes = {r["part"]: r for r in slim.groupBy("part").agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(named))]).collect()}
    wanted: dict[tuple[int, str], list[tuple[_Target, _Target, float]]] = {}
    targets: dict[tuple[int, frozenset[int], int], _Target] = {}
    for union, parts in unions.items():
        own = frozenset(parts)
        for i, name in enumerate(named):
            size = sum(r[f"n{i}"] for p, r in sizes.items() if p in own)
            wanted[union, name] = [
                (*[targets.setdefault((i, own, p), _Target(i, own, p)) for p in (low, high)], share)
                for low, high, share in (_spots(probabilities, size) if size else [])
            ]
    _placed(slim, list(targets.values()), SETTLE_ROWS)
    return {
        key: [a.answer if a.answer == b.answer else a.answer + (b.answer - a.answer) * share for a, b, share in ends] or None
        for key, ends in wanted.items()
    }


def exact(
    df: DataFrame,
    series: dict[str, Column],
    probabilities: Sequence[float],
    small_rows: int = SMALL_ROWS,
) -> dict[str, Column]:
    """Linear-interpolated quantiles of each series, as an ``array<double>`` column for ``df.agg``.

    Small series give a ``percentile`` aggregate that runs with the caller's other aggregates;
    large ones are solved here and give a constant.
    """
    sizes = counts(df, series)
    out: dict[str, Column] = {}
    large: dict[str, list[tuple[int, int, float]]] = {}
    for name, size in sizes.items():
        if size <= small_rows:
            out[name] = F.percentile(known(series[name]), list(map(float, probabilities)))
            continue
        large[name] = _spots(probabilities, size)
    wanted = [(n, place) for n, spots in large.items() for lo, hi, _ in spots for place in (lo, hi)]
    if wanted:
        found = select(df, {n: series[n] for n in large}, wanted, min(small_rows, SETTLE_ROWS))
        for name, spots in large.items():
            ends = [(found[name, lo], found[name, hi], part) for lo, hi, part in spots]
            out[name] = F.array(*[F.lit(a + (b - a) * part) for a, b, part in ends])
    return out


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value, ties counted one by one."""
    series = {column: F.col(column)}
    sizes = counts(df, series)
    place = sizes[column] - k
    return select(df, series, [(column, place)])[column, place]
