"""Penalised linear models of all folds from shared passes.

A *lane* is one model: the rows of one holdout's training folds, as vectors. One aggregate adds up, for all lanes
together, what a step needs: for `ridge` the moments of features and target, once; for `logistic` the gradient and the curvature of
every lane at its own coefficients, once per Newton step. The sums are small (the square of the number of features), are added
up in a fixed order, and the systems are solved on the driver. Steps that do not lower the loss are halved, lane by
lane, so a model is at its optimum when its gradient vanishes; `tolerance` is relative to the rows.

Rows are kept as blocks in which a feature of few values has small codes for them, so indicators take a bit a row. Every
pass reads the blocks from the shared folder; a task holds one of them, and the batch it came in.

The matrix of a lane has the square of its features: models of more than `MOST_FEATURES` are for an iterative estimator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsafe.errors import TrainingError
from foldsafe.operators import partials
from foldsafe.sources import scratch

MOST_FEATURES = 512
_BLOCK_ROWS = 1 << 12
_BLOCKS = "lane int, label binary, x binary"


@dataclass(frozen=True)
class Linear:
    coefficients: list[float]
    intercept: float
    steps: int


class Lanes:
    """Vectors packed into blocks per lane, kept for several passes. Use as a context manager."""

    def __init__(self, lanes: DataFrame):
        """``lanes`` has ``lane int, label double, features array<double>`` without blanks."""
        picked = lanes.select(F.col("lane").cast("int").alias("lane"), F.col("label").cast("double").alias("label"), "features")
        cores = lanes.sparkSession.sparkContext.defaultParallelism
        packed = picked.mapInArrow(_pack, _BLOCKS)
        packed = packed.repartition(cores) if picked.rdd.getNumPartitions() < cores else packed
        self._blocks = scratch.blocks(packed, "linear-rows")
        self._parts = self._blocks.rdd.getNumPartitions()
        self.passes = 0

    def __enter__(self) -> Lanes:
        return self

    def __exit__(self, *error) -> None:
        pass

    def sums(self, of: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
        """Per lane the sum over its blocks of an array made from (lane, vectors with a leading 1, labels)."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, lane in enumerate(batch.column(0).to_pylist()):
                    y = partials.array_of(batch.column(1)[i].as_buffer())
                    x = _decoded(batch.column(2)[i].as_buffer(), len(y))
                    part = of(lane, x, y)
                    totals[lane] = totals[lane] + part if lane in totals else part
            part = TaskContext.get().partitionId()
            for lane, total in totals.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lane], pa.int32()), pa.array([part], pa.int64()), pa.array([total.astype("<f8").tobytes()], pa.binary())],
                    names=["lane", partials.PART, partials.BODY],
                )

        self.passes += 1
        parts = self._blocks.mapInArrow(task, f"lane int, {partials.PART} long, {partials.BODY} binary")
        totals: dict[int, np.ndarray] = {}
        rows = partials.summed(parts, ["lane"], self._parts, partials.FAN_IN).collect()
        for row in sorted(rows, key=lambda r: r[partials.PART]):
            body = partials.array_of(row[partials.BODY])
            totals[row["lane"]] = totals[row["lane"]] + body if row["lane"] in totals else body
        return totals


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.column(1).null_count:
            raise TrainingError("rows without a label cannot be learnt from")
        owner, label = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for lane in np.unique(owner).tolist():
            own = np.flatnonzero(owner == lane)
            for first in range(0, len(own), _BLOCK_ROWS):
                rows = own[first: first + _BLOCK_ROWS]
                x = batch.column(2).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lane], pa.int32()), pa.array([label[rows].astype("<f8").tobytes()], pa.binary()), pa.array([_encoded(x)], pa.binary())],
                    names=["lane", "label", "x"],
                )


def _encoded(x: np.ndarray) -> bytes:
    """Columns of numbers, bit for bit: of up to 256 different ones those and a byte per row, of two a bit per row."""
    columns = np.ascontiguousarray(x.T, "<f8").view("<i8")
    sizes, bodies = [], []
    for column in columns:
        found, place = np.unique(column, return_inverse=True)
        if len(found) > 256:
            sizes.append(0)
            bodies.append(column.tobytes())
            continue
        sizes.append(len(found))
        bodies.append(found.tobytes())
        if len(found) > 1:
            codes = place.astype(np.uint8)
            bodies.append((np.packbits(codes) if len(found) == 2 else codes).tobytes())
    return np.array([len(sizes), *sizes], "<u2").tobytes() + b"".join(bodies)


def _decoded(body: pa.Buffer, rows: int) -> np.ndarray:
    """The rows of a block with a leading 1."""
    width = int(np.frombuffer(body, "<u2", 1)[0])
    sizes = np.frombuffer(body, "<u2", width, 2).tolist()
    out, at = np.empty((width + 1, rows)), 2 + 2 * width
    out[0] = 1.0
    for column, size in zip(out[1:], sizes):
        values = np.frombuffer(body, "<f8", size or rows, at)
        at += 8 * len(values)
        if size < 2:
            column[:] = values
            continue
        n = (rows + 7) // 8 if size == 2 else rows
        codes = np.frombuffer(body, np.uint8, n, at)
        at += n
        np.take(values, np.unpackbits(codes, count=rows) if size == 2 else codes, out=column)
    return out.T


def ridge(lanes: Lanes, alpha: float = 1.0, intercept: bool = True) -> dict[int, Linear]:
    """Least squares plus ``alpha`` times the squared coefficients (the intercept is free), per lane, from two passes:
    means first, then moments about them, so that large means cancel nothing."""
    first = lanes.sums(lambda lane, x, y: np.concatenate((x.sum(0), [y.sum()])))
    centres = {lane: s / s[0] if intercept else np.zeros(len(s)) for lane, s in first.items()}

    def moments(lane: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.column_stack((x[:, 1:], y)) - centres[lane][1:]
        return (z.T @ z).ravel()

    found = {}
    for lane, total in lanes.sums(moments).items():
        width = len(centres[lane]) - 1
        both = total.reshape(width, width)
        w = _solved(both[:-1, :-1] + alpha * np.eye(width - 1), both[:-1, -1])
        centre = centres[lane]
        found[lane] = Linear(w.tolist(), float(centre[-1] - centre[1:-1] @ w), 1)
    return found


def logistic(
    lanes: Lanes, c: float = 1.0, intercept: bool = True, most_steps: int = 100, tolerance: float = 1e-10
) -> dict[int, Linear]:
    """Log loss plus the squared coefficients over 2 ``c`` (the intercept is free), per lane, by Newton steps."""
    first = lanes.sums(lambda lane, x, y: np.concatenate((x.sum(0), [y.sum()])))
    rows = {lane: s[0] for lane, s in first.items()}
    weights, steps = {lane: np.zeros(len(s) - 1) for lane, s in first.items()}, dict.fromkeys(first, 0)
    for lane, s in first.items():
        share = min(max(s[-1] / s[0], 1e-9), 1 - 1e-9)
        weights[lane][0] = np.log(share / (1 - share)) if intercept else 0.0
    moves: dict[int, np.ndarray] = {}
    losses: dict[int, float] = {}
    active = set(weights)
    for _ in range(most_steps):
        tried = {lane: weights[lane] + moves[lane] if lane in moves else weights[lane] for lane in active}

        def derivatives(lane: int, x: np.ndarray, y: np.ndarray, at: dict = tried) -> np.ndarray:
            if lane not in at:
                return np.zeros(0)
            m = x @ at[lane]
            p = 1 / (1 + np.exp(-m))
            loss = np.logaddexp(0, m).sum() - y @ m
            return np.concatenate(([loss], x.T @ (p - y), ((x * (p * (1 - p))[:, None]).T @ x).ravel()))

        for lane, total in lanes.sums(derivatives).items():
            if lane not in active:
                continue
            w, width = tried[lane], len(weights[lane])
            penalty = np.full(width, 1.0 / c)
            penalty[0] = 0.0
            loss = total[0] + (penalty * w * w).sum() / 2
            if lane in losses and loss > losses[lane] * (1 + 1e-12) + 1e-12:
                moves[lane] = moves[lane] / 2
                if np.abs(moves[lane]).max() < 1e-14:
                    active.discard(lane)
                continue
            weights[lane], losses[lane] = w, loss
            steps[lane] += 1
            slope = total[1: 1 + width] + penalty * w
            curve = total[1 + width:].reshape(width, width) + np.diag(penalty)
            free = slice(0 if intercept else 1, None)
            if np.abs(slope[free]).max(initial=0.0) <= tolerance * rows[lane]:
                active.discard(lane)
                continue
            move = np.zeros(width)
            move[free] = -_solved(curve[free, free], slope[free])
            moves[lane] = move
        if not active:
            break
    return {lane: Linear(w[1:].tolist(), float(w[0]), steps[lane]) for lane, w in weights.items()}


def _solved(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution, the shortest one where columns depend on each other."""
    try:
        return np.linalg.solve(matrix, right)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(matrix, right, rcond=None)[0]
