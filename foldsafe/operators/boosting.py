"""Boosted trees on histograms, for all folds together, with missing values of their own.

A *lane* is one model being trained: the rows of one holdout's training folds. All lanes grow their next tree at the
same time. Features are put into at most 255 bins per lane once, with a code of its own for a missing value, and the
rows of a lane are packed into blocks of codes. Each level of a tree is then one aggregate: every task adds up gradients,
curvatures and rows per (lane, node, feature, bin) over its blocks, these arrays are added up in a fixed order, and the best split
of every node is read off them. Missing values go to the side where they gain more. So a job per level serves
all folds, whatever their number, and what reaches the driver depends on lanes, nodes and bins only, not on rows.

Gain of a split and value of a leaf follow from sums G of gradients and H of curvatures: G^2/(H + penalty) of both
sides less that of the node, and -rate * G/(H + penalty).

Scores of earlier trees are kept with the blocks in a persisted table. The last few trees are applied on the way; every
`_TREES_PER_STEP` trees the table is made anew with them, in the job that grows the next tree, and every `_STEPS_PER_WRITE`
steps it is written to the shared folder, so a lost executor costs some trees' scores. Row samples come from the rows'
key and the tree's number, so a task that runs again sees the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from foldsafe.errors import TrainingError
from foldsafe.operators import partials
from foldsafe.sources.scratch import blocks, written

MISSING = 255
MOST_BINS = 255
_BLOCK_ROWS = 1 << 14
_TREES_PER_STEP = 4
_STEPS_PER_WRITE = 8
# Levels up to which splits are judged node by node on whole rows of codes.
_FLAT_LEVELS = 6
# Features are counted together while their bins and the nodes make up at most so many cells.
_BUNDLE_CELLS = 1 << 12
# Rows whose values a task sorts at a time for the bins, and the values it hands out of them.
_SORTED_ROWS, _SUMMARY = 1 << 18, 1 << 12
# Arrays of up to so many bytes in all are added up on the driver, larger ones in tasks first.
_DRIVER_BYTES = 1 << 24
_BLOCKS = "lane int, label binary, key binary, codes binary, margin binary"


@dataclass(frozen=True)
class Settings:
    rounds: int = 100
    depth: int = 3
    rate: float = 0.1
    bins: int = MOST_BINS
    penalty: float = 0.0
    least_rows: int = 1
    least_weight: float = 0.0
    row_share: float = 1.0
    feature_share: float = 1.0
    symmetric: bool = False
    by_rows: bool = False
    from_prior: bool = True
    seed: int = 42

    def __post_init__(self) -> None:
        if not 2 <= self.bins <= MOST_BINS:
            raise TrainingError(f"between 2 and {MOST_BINS} bins are possible")
        if self.rounds < 1 or self.depth < 1 or self.depth > 12 or not self.rate > 0 or self.penalty < 0:
            raise TrainingError("rounds, depth (at most 12), rate and penalty must be positive")
        if not 0 < self.row_share <= 1 or not 0 < self.feature_share <= 1:
            raise TrainingError("shares lie between 0 and 1")


@dataclass
class Tree:
    """Nodes in heap order: the children of node i are 2i + 1 (left) and 2i + 2. A leaf has feature -1."""

    feature: np.ndarray
    code: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n))

    def leaves(self, codes: np.ndarray, levels: int) -> np.ndarray:
        """The node each row is at after so many levels; `codes` has a row per feature."""
        if levels <= _FLAT_LEVELS:
            return self._flat(codes, levels).astype(np.intp)
        node = np.zeros(codes.shape[1], np.int32)
        rows = np.arange(codes.shape[1])
        for _ in range(levels):
            feature = self.feature[node]
            if (feature < 0).all():
                break
            code = codes[np.maximum(feature, 0), rows]
            left = np.where(code == MISSING, self.missing_left[node], code <= self.code[node])
            node = np.where(feature >= 0, 2 * node + 2 - left, node)
        return node

    def _flat(self, codes: np.ndarray, levels: int) -> np.ndarray:
        """The same by comparing whole rows of codes per node: cheaper than finding each row's split while nodes are few."""
        node = np.zeros(codes.shape[1], np.uint8)
        for level in range(levels):
            moved = node.copy()
            for i in range(2**level - 1, 2 ** (level + 1) - 1):
                if self.feature[i] < 0:
                    continue
                own = codes[self.feature[i]]
                left = own <= int(self.code[i])
                if self.missing_left[i]:
                    left |= own == MISSING
                # The step to the child, where the row is at this node: bytes without branches.
                here = np.negative((node == i).view(np.uint8))
                moved += (np.uint8(i + 2) - left.view(np.uint8)) & here
            node = moved
        return node


@dataclass
class Ensemble:
    """The trees of one lane, with thresholds on the features themselves: a value goes left if it is at most the threshold."""

    base: float
    edges: list[np.ndarray]
    trees: list[Tree]
    task: str

    def state(self) -> dict:
        """Plain lists, of nodes that are used only; a threshold stands for a code."""
        packed = []
        for tree in self.trees:
            used = np.flatnonzero((tree.feature >= 0) | (tree.value != 0))
            last = int(used[-1]) + 1 if len(used) else 1
            if (tree.feature[:last] >= 0).any():
                last = max(last, 2 * int(np.flatnonzero(tree.feature >= 0)[-1]) + 3)
            cut = [float(self.edges[f][c]) if f >= 0 else 0.0 for f, c in zip(tree.feature[:last], tree.code[:last])]
            packed.append([tree.feature[:last].tolist(), cut, tree.missing_left[:last].astype(int).tolist(), tree.value[:last].tolist()])
        return {"base": self.base, "task": self.task, "width": len(self.edges), "trees": packed}


def margins(state: dict, x: np.ndarray) -> np.ndarray:
    """The sum of all trees for rows of features, NaN where a value is missing."""
    out = np.full(len(x), state["base"])
    rows = np.arange(len(x))
    columns = np.ascontiguousarray(x.T)
    blank = np.isnan(columns)
    for feature, cut, missing_left, value in state["trees"]:
        levels = len(feature).bit_length() - 1
        if levels <= _FLAT_LEVELS:
            out += np.array(value)[_flat_nodes(feature, cut, missing_left, columns, blank, levels)]
            continue
        feature, cut = np.array(feature), np.array(cut)
        missing_left, value = np.array(missing_left, bool), np.array(value)
        node = np.zeros(len(x), np.int64)
        for _ in range(levels):
            f = feature[node]
            at = np.maximum(f, 0)
            left = np.where(blank[at, rows], missing_left[node], columns[at, rows] <= cut[node])
            node = np.where(f >= 0, 2 * node + 2 - left, node)
        out += value[node]
    return out


def _flat_nodes(feature: list, cut: list, missing_left: list, columns: np.ndarray, blank: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row after all levels, by whole columns per node (see `Tree._flat`)."""
    node = np.zeros(columns.shape[1], np.uint8)
    for level in range(levels):
        moved = node.copy()
        for i in range(2**level - 1, min(2 ** (level + 1) - 1, len(feature))):
            if feature[i] < 0:
                continue
            left = columns[feature[i]] <= cut[i]
            if missing_left[i]:
                left |= blank[feature[i]]
            here = np.negative((node == i).view(np.uint8))
            moved += (np.uint8(i + 2) - left.view(np.uint8)) & here
        node = moved
    return node.astype(np.intp)


def bin_edges(lanes: DataFrame, bins: int) -> dict[int, list[np.ndarray]]:
    """Per lane and feature the upper ends of its bins, from one pass: quantiles with the smallest and largest value.

    Tasks hand out their values in order, thinned to `_SUMMARY` of every `_SORTED_ROWS` rows where there are more; so a quantile's
    rank is off by at most a `_SUMMARY`th of the rows, and is exact with fewer distinct values.

    A value has the code of the first end that is not below it. Up to `bins` distinct values have a bin each if every one makes up
    1/`bins` of the rows; a lane without any value of a feature has no ends for it.
    """
    shares = np.array([(i + 1) / (bins - 1) for i in range(bins - 2)] or [0.5])

    def merge(table: pa.Table) -> pa.Table:
        values, weights = (np.concatenate([partials.array_of(b.as_buffer()) for b in table.column(c)]) for c in ("value", "weight"))
        ends = np.zeros(0)
        if len(values):
            order = np.argsort(values, kind="stable")
            values, upto = values[order], np.cumsum(weights[order])
            inner = values[np.searchsorted(upto, np.maximum(np.ceil(shares * upto[-1]), 1))]
            ends = np.unique(np.concatenate((values[:1], inner, values[-1:])))[:MOST_BINS]
        return pa.table({**{c: table.column(c).slice(0, 1) for c in ("lane", "feature")}, "ends": pa.array([ends.astype("<f8").tobytes()], pa.binary())})

    parts = lanes.select("lane", "features").mapInArrow(_summaries, "lane int, feature int, value binary, weight binary")
    found = parts.groupBy("lane", "feature").applyInArrow(merge, "lane int, feature int, ends binary")
    edges: dict[int, list[np.ndarray]] = {}
    for row in sorted(found.collect(), key=lambda r: (r["lane"], r["feature"])):
        edges.setdefault(row["lane"], []).append(partials.array_of(row["ends"]))
    return edges


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per lane, feature and some hundred thousand rows: the values in order with their rows, or of many values every so-manieth."""
    held: dict[int, list[np.ndarray]] = {}
    # No more rows than that in all, of whatever lanes a part has.
    rows_of: dict[int, int] = {}

    def told(lane: int) -> Iterator[pa.RecordBatch]:
        rows_of.pop(lane)
        x = np.concatenate(held.pop(lane))
        for f in range(x.shape[1]):
            column = x[:, f]
            column = np.sort(column[~np.isnan(column)]) + 0.0
            last = np.flatnonzero(np.append(column[1:] != column[:-1], True)) if len(column) else np.zeros(0, np.int64)
            if len(last) > _SUMMARY:
                # The smallest value is kept: it is an end of its own.
                last = np.unique(np.append(0, np.arange(1, _SUMMARY + 1) * len(column) // _SUMMARY - 1))
            weight = np.diff(last, prepend=-1).astype("<f8")
            yield pa.RecordBatch.from_arrays(
                [pa.array([lane], pa.int32()), pa.array([f], pa.int32()), pa.array([column[last].astype("<f8").tobytes()], pa.binary()), pa.array([weight.tobytes()], pa.binary())],
                names=["lane", "feature", "value", "weight"],
            )

    for batch in batches:
        owner = batch.column(0).to_numpy()
        for lane in np.unique(owner).tolist():
            rows = pa.array(np.flatnonzero(owner == lane))
            x = batch.column(1).take(rows).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            held.setdefault(lane, []).append(x)
            rows_of[lane] = rows_of.get(lane, 0) + len(x)
            if sum(rows_of.values()) >= _SORTED_ROWS:
                yield from told(max(rows_of, key=rows_of.get))
    for lane in sorted(held):
        yield from told(lane)


def _blocks(lanes: DataFrame, edges: dict[int, list[np.ndarray]], bases: dict[int, float]) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner = batch.column(0).to_numpy()
            for lane in np.unique(owner).tolist():
                rows = pa.array(np.flatnonzero(owner == lane))
                label, key, lists = (batch.column(i).take(rows) for i in (1, 2, 3))
                x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                codes = np.empty(x.shape[::-1], np.uint8)
                for f, ends in enumerate(edges[lane]):
                    column = x[:, f]
                    code = np.minimum(np.searchsorted(ends, column), max(len(ends) - 1, 0))
                    codes[f] = np.where(np.isnan(column), MISSING, code)
                for first in range(0, len(rows), _BLOCK_ROWS):
                    part = slice(first, first + _BLOCK_ROWS)
                    y = label.to_numpy(zero_copy_only=False)[part].astype("<f8")
                    yield _packed(lane, y.tobytes(), key.to_numpy()[part].astype("<i8").tobytes(),
                                  codes[:, part].tobytes(), np.full(len(y), bases[lane], "<f8").tobytes())

    return lanes.select("lane", "label", "key", "features").mapInArrow(task, _BLOCKS)


def _packed(lane: int, *bodies: bytes) -> pa.RecordBatch:
    columns = [pa.array([lane], pa.int32()), *[pa.array([b], pa.binary()) for b in bodies]]
    return pa.RecordBatch.from_arrays(columns, names=["lane", "label", "key", "codes", "margin"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    lanes = batch.column(0).to_pylist()
    for i, lane in enumerate(lanes):
        label, key, codes, margin = (batch.column(c)[i].as_buffer() for c in (1, 2, 3, 4))
        y = np.frombuffer(label, "<f8")
        yield lane, y, np.frombuffer(key, "<i8"), np.frombuffer(codes, np.uint8).reshape(-1, max(len(y), 1)), np.frombuffer(margin, "<f8")


def _sampled(key: np.ndarray, tree: int, settings: Settings) -> np.ndarray | None:
    """Which rows a tree sees: by a hash of the row's key, the tree and the seed."""
    if settings.row_share >= 1:
        return None
    return uniform(key, tree, settings.seed) < settings.row_share


def uniform(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Numbers from 0 to below 1 by a hash of rows' keys, a tree's number and a seed."""
    x = key.astype(np.uint64) ^ np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _slopes(y: np.ndarray, margin: np.ndarray, task: str) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the loss: log loss, or half the squared error."""
    if task != "binary":
        return margin - y, np.ones(len(y))
    p = 1 / (1 + np.exp(-margin))
    return p - y, np.maximum(p * (1 - p), 1e-16)


class _Layout:
    """Where the cells of a lane's histograms lie: per feature its bins, then the missing ones."""

    def __init__(self, edges: list[np.ndarray]):
        self.sizes = np.array([max(len(e), 1) + 1 for e in edges], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.cells = int(self.sizes.sum())

    def bundles(self, nodes: int) -> list[list[int]]:
        """Features to count together, the narrow ones first: one cell per combination of their bins."""
        found: list[list[int]] = []
        cells = _BUNDLE_CELLS + 1
        for f in np.argsort(self.sizes, kind="stable").tolist():
            if cells * int(self.sizes[f]) > _BUNDLE_CELLS:
                found.append([])
                cells = nodes + 1
            found[-1].append(f)
            cells *= int(self.sizes[f])
        return found

    def histogram(self, by_bundle: Sequence[np.ndarray], nodes: int) -> np.ndarray:
        """Three planes of (node, cell) from the sums per combination."""
        out = np.zeros((3, nodes, self.cells))
        for bundle, total in zip(self.bundles(nodes), by_bundle):
            joint = total.reshape(3, nodes + 1, *self.sizes[bundle].tolist())[:, :nodes]
            for place, f in enumerate(bundle):
                first, size = int(self.first[f]), int(self.sizes[f])
                others = tuple(k + 2 for k in range(len(bundle)) if k != place)
                out[:, :, first: first + size] = joint.sum(others) if others else joint
        return out


def _histogram_job(
    state: DataFrame, layouts: dict[int, _Layout], pending: dict[int, list[Tree]], trees: dict[int, Tree],
    level: int, number: int, settings: Settings, task: str,
) -> DataFrame:
    """One level for all lanes: sums per (node of the level, cell) as an array of three planes per lane."""
    nodes = 2**level

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for lane, y, key, codes, margin in _unpacked(batch):
                g, h = _slopes(y, _moved(margin, codes, pending[lane]), task)
                node = trees[lane].leaves(codes, level) - (nodes - 1)
                use = node >= 0
                seen = _sampled(key, number, settings)
                if seen is not None:
                    use &= seen
                if not use.all():
                    # Rows that take no part are counted for a node behind the last.
                    node = np.where(use, node, nodes)
                bundles, sizes = layouts[lane].bundles(nodes), layouts[lane].sizes.tolist()
                if lane not in counted:
                    counted[lane] = [np.zeros((3, (nodes + 1) * math.prod(sizes[f] for f in b))) for b in bundles]
                for bundle, total in zip(bundles, counted[lane]):
                    cell = node.astype(np.uint16 if total.shape[1] <= 1 << 16 else np.int64)
                    for f in bundle:
                        cell *= sizes[f]
                        cell += np.minimum(codes[f], sizes[f] - 1)
                    cell = cell.astype(np.intp)
                    for plane, weight in enumerate((g, h, None)):
                        total[plane] += np.bincount(cell, weight, total.shape[1])
        part = TaskContext.get().partitionId()
        for lane, by_bundle in counted.items():
            body = layouts[lane].histogram(by_bundle, nodes).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([lane], pa.int32()), pa.array([part], pa.int64()), pa.array([body], pa.binary())],
                names=["lane", partials.PART, partials.BODY],
            )

    return state.mapInArrow(job, f"lane int, {partials.PART} long, {partials.BODY} binary")


def _summed(parts: DataFrame, n_parts: int, layouts: dict[int, _Layout], nodes: int) -> dict[int, np.ndarray]:
    """The histograms of every lane."""
    size = sum(24 * nodes * x.cells for x in layouts.values())
    down_to = partials.FAN_IN if size * min(n_parts, partials.FAN_IN) <= _DRIVER_BYTES else 1
    totals: dict[int, np.ndarray] = {}
    rows = partials.summed(parts, ["lane"], n_parts, down_to).toArrow().to_pylist()
    for row in sorted(rows, key=lambda r: r[partials.PART]):
        body = partials.array_of(row[partials.BODY]).reshape(3, nodes, -1)
        totals[row["lane"]] = totals[row["lane"]] + body if row["lane"] in totals else body
    return totals


@dataclass
class _Split:
    """The best split of one node and the sums (gradient, curvature) of its two sides."""

    feature: int
    code: int
    missing_left: bool
    left: tuple[float, float]
    right: tuple[float, float]


def _gains(total: np.ndarray, layout: _Layout, chosen: np.ndarray, settings: Settings):
    """For each feature: the gains by (missing left or right, node, bin), -inf where a split is not allowed, with the
    sums left of each split."""

    def score(s: np.ndarray) -> np.ndarray:
        weight = s[2] if settings.by_rows else s[1]
        below = weight + settings.penalty
        return np.divide(s[0] ** 2, below, out=np.zeros_like(below), where=below > 0)

    for f in np.flatnonzero(chosen).tolist():
        first, size = int(layout.first[f]), int(layout.sizes[f])
        if size < 2:
            continue
        cells = total[:, :, first: first + size]
        known, blank = cells[:, :, :-1], cells[:, :, -1:]
        whole = cells.sum(2, keepdims=True)
        run = np.cumsum(known, axis=2)
        # Blanks left or right; with blanks, all known values against the blanks is a split too.
        left = np.stack((run + blank, run))
        right = whole[None] - left
        rows_left, rows_right = left[:, 2], right[:, 2]
        gain = np.stack([score(left[s]) + score(right[s]) - score(whole) for s in (0, 1)])
        need = max(settings.least_rows, 1)
        allowed = (rows_left >= need) & (rows_right >= need)
        allowed &= (left[:, 1] >= settings.least_weight) & (right[:, 1] >= settings.least_weight)
        # Without blanks both sides of the choice are one split; blanks to come then go where more rows went.
        none = blank[2] == 0
        more_left = rows_left[0] >= rows_right[0]
        if settings.symmetric:
            # One side for the whole level.
            none = np.broadcast_to(none.all(0), none.shape)
            more_left = np.broadcast_to(rows_left[0].sum(0) >= rows_right[0].sum(0), more_left.shape)
        allowed[0] &= ~(none & ~more_left)
        allowed[1] &= ~(none & more_left)
        yield f, np.where(allowed, gain, -np.inf), left


def _best_splits(total: np.ndarray, layout: _Layout, chosen: np.ndarray, settings: Settings) -> tuple[list[_Split | None], np.ndarray]:
    """The best split of each node of a level (ties: the first feature, then the smallest bin), and the nodes' sums.

    Symmetric trees take one split for the whole level: the one whose gains over all nodes add up to most.
    """
    nodes = total.shape[1]
    first, size = int(layout.first[0]), int(layout.sizes[0])
    sums = total[:, :, first: first + size].sum(2)
    best, found = np.full(nodes, -np.inf), [None] * nodes
    least = 1e-12
    for f, gain, left in _gains(total, layout, chosen, settings):
        if settings.symmetric:
            # A node the split does not part gains nothing by it, and does not stand in its way.
            over = np.where(np.isfinite(gain), gain, 0.0).sum(1)
            over = np.where(np.isfinite(gain).any(1), over, -np.inf)
            pick = np.unravel_index(np.argmax(over.T), over.T.shape)[::-1]
            if over[pick] > max(best[0], least):
                best[:] = over[pick]
                found = [_Split(f, int(pick[1]), pick[0] == 0, *_sides(left, sums, pick[0], n, pick[1])) for n in range(nodes)]
            continue
        for n in range(nodes):
            by_bin = gain[:, n].T
            bin_, side = np.unravel_index(np.argmax(by_bin), by_bin.shape)
            if by_bin[bin_, side] > max(best[n], least):
                best[n] = by_bin[bin_, side]
                found[n] = _Split(f, int(bin_), side == 0, *_sides(left, sums, side, n, bin_))
    return found, sums


def _sides(left: np.ndarray, sums: np.ndarray, side: int, node: int, bin_: int):
    g, h = float(left[side, 0, node, bin_]), float(left[side, 1, node, bin_])
    return (g, h), (float(sums[0, node]) - g, float(sums[1, node]) - h)


def _value(side: tuple[float, float], settings: Settings) -> float:
    below = side[1] + settings.penalty
    return -settings.rate * side[0] / below if below > 0 else 0.0


def _moved(margin: np.ndarray, codes: np.ndarray, trees: list[Tree]) -> np.ndarray:
    """Scores with the values of more trees."""
    for tree in trees:
        margin = margin + tree.value[tree.leaves(codes, len(tree.value).bit_length() - 1)]
    return margin


def _after(state: DataFrame, pending: dict[int, list[Tree]]) -> DataFrame:
    """The state with trees' values added to the scores."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (lane, _, _, codes, margin) in enumerate(_unpacked(batch)):
                moved = _moved(margin, codes, pending[lane])
                yield _packed(lane, *[batch.column(c)[i].as_py() for c in (1, 2, 3)], moved.astype("<f8").tobytes())

    return state.mapInArrow(job, _BLOCKS)


def lane_facts(lanes: DataFrame) -> list[Row]:
    """Rows, mean and variance of the labels and number of features of each lane; an error if rows cannot be learnt from."""
    facts = lanes.groupBy("lane").agg(
        F.avg("label").alias("mean"), F.count(F.lit(1)).alias("rows"), F.count("label").alias("labels"),
        F.min(F.size("features")).alias("least"), F.max(F.size("features")).alias("most"), F.var_pop("label").alias("variance"),
        F.count_if(~F.col("label").isin(0.0, 1.0)).alias("other"),
    ).collect()
    for row in facts:
        if row["labels"] < row["rows"]:
            raise TrainingError("rows without a label cannot be learnt from")
        if row["least"] != row["most"] or not row["most"]:
            raise TrainingError("rows of a lane need the same features, one at least")
    return facts


def fit(lanes: DataFrame, settings: Settings, task: str = "binary") -> dict[int, Ensemble]:
    """An ensemble per lane of a table ``lane int, key long, label double, features array<double>``.

    A blank feature is NaN. Rows without a label are an error. A lane without rows has no ensemble.
    """
    lanes = written(lanes.select(F.col("lane").cast("int").alias("lane"), "key", "label", "features"), "boosting-rows")
    facts = lane_facts(lanes)
    edges = bin_edges(lanes, settings.bins)
    bases = {r["lane"]: _base(r["mean"], task, settings) for r in facts}
    layouts = {lane: _Layout(e) for lane, e in edges.items()}
    packed, cores = _blocks(lanes, edges, bases), lanes.sparkSession.sparkContext.defaultParallelism
    # A small table may come in fewer partitions than there are cores to use.
    packed = packed.repartition(cores) if lanes.rdd.getNumPartitions() < cores else packed
    found: dict[int, list[Tree]] = {lane: [] for lane in edges}
    tables = [blocks(packed, "boosting-state").persist(StorageLevel.MEMORY_AND_DISK)]
    n_parts = tables[0].rdd.getNumPartitions()
    pending: dict[int, list[Tree]] = {lane: [] for lane in edges}
    try:
        for number in range(settings.rounds if edges else 0):
            trees = _grow(tables[-1], n_parts, layouts, pending, number, settings, task)
            # The table the newest one was made from has served.
            while len(tables) > 1:
                tables.pop(0).unpersist()
            for lane, tree in trees.items():
                found[lane].append(tree)
                pending[lane].append(tree)
            if (number + 1) % _TREES_PER_STEP == 0 and number + 1 < settings.rounds:
                state = _after(tables[-1], pending)
                if (number + 1) % (_TREES_PER_STEP * _STEPS_PER_WRITE) == 0:
                    state = blocks(state, "boosting-state")
                    n_parts = state.rdd.getNumPartitions()
                tables.append(state.persist(StorageLevel.MEMORY_AND_DISK))
                pending = {lane: [] for lane in edges}
    finally:
        for table in tables:
            table.unpersist()
    return {lane: Ensemble(bases[lane], edges[lane], trees, task) for lane, trees in found.items()}


def _base(mean: float, task: str, settings: Settings) -> float:
    if not settings.from_prior:
        return 0.0
    if task != "binary":
        return float(mean)
    p = min(max(mean, 1e-9), 1 - 1e-9)
    return float(np.log(p / (1 - p)))


def _grow(
    state: DataFrame, n_parts: int, layouts: dict[int, _Layout], pending: dict[int, list[Tree]],
    number: int, settings: Settings, task: str,
) -> dict[int, Tree]:
    """The next tree of every lane, level by level."""
    trees = {lane: Tree.empty(settings.depth) for lane in layouts}
    chosen = {lane: _features(len(x.sizes), lane, number, settings) for lane, x in layouts.items()}
    for level in range(settings.depth):
        first = 2**level - 1
        parts = _histogram_job(state, layouts, pending, trees, level, number, settings, task)
        grown = False
        for lane, total in _summed(parts, n_parts, layouts, 2**level).items():
            tree = trees[lane]
            splits, sums = _best_splits(total, layouts[lane], chosen[lane], settings)
            for n, split in enumerate(splits):
                node = first + n
                if level == 0:
                    tree.value[0] = _value((float(sums[0, 0]), float(sums[1, 0])), settings)
                if split is None or (level and tree.feature[(node - 1) // 2] < 0):
                    continue
                grown = True
                tree.feature[node], tree.code[node], tree.missing_left[node] = split.feature, split.code, split.missing_left
                tree.value[2 * node + 1], tree.value[2 * node + 2] = _value(split.left, settings), _value(split.right, settings)
                tree.value[node] = 0.0
        if not grown:
            break
    return trees


def _features(n: int, lane: int, number: int, settings: Settings) -> np.ndarray:
    """The features a tree may use: a share of them, at least one."""
    chosen = np.ones(n, bool)
    if settings.feature_share < 1:
        few = max(1, int(settings.feature_share * n))
        order = np.random.default_rng([settings.seed, lane + 1, number]).permutation(n)
        chosen[order[few:]] = False
    return chosen

