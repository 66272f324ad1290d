"""Forests of deep trees on bins, all trees of all folds together.

A *lane* is one forest being trained: the rows of one holdout's training folds. Features are put into bins once
(`boosting.bin_edges`), and the rows of a lane are packed into blocks of codes. A tree sees a row as often as a Poisson draw
from the row's hash and the tree's number says, and a node may be split by a share of the features drawn for it, as in Spark ML's
forest. Splits are those that lower the labels' variance most; for labels 0 and 1 that order is the one by Gini impurity.

Trees are grown in two steps. Nodes of more than `_LOCAL_ROWS` rows are split level by level: tasks count their blocks per (lane,
tree, node, drawn feature, bin), the counts are added up, and the best splits are read off in tasks too. The rows of all
smaller nodes are then dealt out by node in one shuffle, and each group grows the rest of its tree by itself, whatever
its depth. So there are a few jobs over all folds and trees instead of some per level and fold, a group has a bounded
number of rows, and the number of groups grows with the table. Rows of a group with the same codes and label count as one, with
the weights of all: as bins are few, the work of a group falls with the number of such rows.

Finished trees stay in a table in the shared folder, in pieces: the top of a tree (`root` -1) and what grew below each of its ends.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsafe.errors import TrainingError
from foldsafe.operators import boosting, partials
from foldsafe.sources.scratch import blocks, written

# Nodes of at most so many rows are finished by one group.
_LOCAL_ROWS = 1 << 18
_TOP = -1
_CODES = 256
# Of the labels' variance: less is no gain.
_LEAST_GAIN = 1e-9
_PIECES = "lane int, tree int, root int, body binary"
_CHUNKS = "lane int, tree int, root int, place long, weight binary, label binary, codes binary"
_DECIDED = "lane int, tree int, feature binary, cut binary, sums binary"


@dataclass(frozen=True)
class Settings:
    trees: int = 20
    depth: int = 5
    bins: int = 32
    least_rows: int = 1
    features: str = "auto"
    row_rate: float = 1.0
    seed: int = 42

    def __post_init__(self) -> None:
        if not 2 <= self.bins <= boosting.MOST_BINS:
            raise TrainingError(f"between 2 and {boosting.MOST_BINS} bins are possible")
        if self.trees < 1 or not 0 <= self.depth <= 30 or self.least_rows < 1 or not 0 < self.row_rate <= 1:
            raise TrainingError("trees and rows of a leaf must be positive, depth 0 to 30, the share of rows above 0 and up to 1")
        self.drawn(1, "binary")

    def drawn(self, n: int, task: str) -> int:
        """How many of n features are drawn for a node."""
        kind = self.features.lower()
        if kind == "auto":
            kind = "all" if self.trees == 1 else "sqrt" if task == "binary" else "onethird"
        if kind in ("all", "onethird", "sqrt", "log2"):
            named = {"all": n, "onethird": math.ceil(n / 3), "sqrt": math.ceil(math.sqrt(n)), "log2": math.ceil(math.log2(n))}
            return max(1, named[kind])
        try:
            count = int(kind) if kind.isdigit() else math.ceil(float(kind) * n) if 0 < float(kind) <= 1 else 0
        except ValueError:
            count = 0
        if count < 1:
            raise TrainingError(f"unknown number of features {self.features!r}")
        return min(count, n)


@dataclass
class _Lane:
    """What tasks know of a lane: labels are counted from `centre`."""

    width: int
    drawn: int
    centre: float
    least_gain: float


@dataclass
class _Top:
    """The upper part of a tree while it grows. Ends are leaves, `open` (to be split by counts) or `small` (a group's)."""

    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [boosting.MISSING])
    child: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])
    open: list[int] = field(default_factory=list)
    small: list[int] = field(default_factory=list)

    def add(self, depth: int) -> int:
        at = len(self.feature)
        for held, x in ((self.feature, 0), (self.cut, boosting.MISSING), (self.child, at), (self.value, 0.0), (self.depth, depth)):
            held.append(x)
        return at

    def nodes(self) -> Nodes:
        return Nodes(np.array(self.feature, "<i2"), np.array(self.cut, "u1"), np.array(self.child, "<i4"), np.array(self.value, "<f8"))


@dataclass
class Nodes:
    """A tree or a piece of one. A code above `cut` goes to `child` + 1, any other to `child`; a leaf is its own child."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    value: np.ndarray

    def packed(self) -> bytes:
        n = np.array([len(self.feature)], "<i4").tobytes()
        return zlib.compress(n + b"".join(x.tobytes() for x in (self.feature, self.cut, self.child, self.value)), 1)

    @classmethod
    def unpacked(cls, body: bytes) -> Nodes:
        raw = zlib.decompress(body)
        n, at, found = int(np.frombuffer(raw, "<i4", 1)[0]), 4, []
        for kind in ("<i2", "u1", "<i4", "<f8"):
            found.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        return cls(*found)

    def ends(self, codes: np.ndarray) -> np.ndarray:
        """The node each row ends in; `codes` has a row per row."""
        flat, first = codes.reshape(-1), np.arange(len(codes)) * codes.shape[1]
        node = np.zeros(len(codes), np.intp)
        while True:
            moved = self.child[node] + (flat[first + self.feature[node]] > self.cut[node])
            if (moved == node).all():
                return node
            node = moved


class Forest:
    """The trees of one lane as packed pieces, put together where they are used."""

    def __init__(self, edges: list[list[float]], base: float, trees: int, pieces: list[tuple[int, int, bytes]]):
        self.edges, self.base, self.n, self.pieces = edges, base, trees, pieces
        self.trees: list[Nodes] | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The mean over all trees for rows of features."""
        if self.trees is None:
            by_tree: dict[int, dict[int, bytes]] = {}
            for tree, root, body in self.pieces:
                by_tree.setdefault(tree, {})[root] = body
            self.trees = [_whole(by_tree[t], self.base) for t in sorted(by_tree)]
            self.pieces = []
        codes = np.empty(x.shape, np.uint8)
        for f, ends in enumerate(self.edges):
            code = np.minimum(np.searchsorted(ends, x[:, f]), max(len(ends) - 1, 0))
            codes[:, f] = np.where(np.isnan(x[:, f]), boosting.MISSING, code)
        total = np.zeros(len(x))
        for tree in self.trees:
            total += tree.value[tree.ends(codes)]
        return total / self.n


def _whole(pieces: dict[int, bytes], base: float) -> Nodes:
    """One tree from its top and what grew below; ends that no row of the tree came to have the value `base`."""
    top = Nodes.unpacked(pieces[_TOP])
    feature, cut, child, value = top.feature.copy(), top.cut.copy(), top.child.copy(), top.value.copy()
    parts, at = [], len(feature)
    value[np.isnan(value)] = base
    for root in sorted(r for r in pieces if r != _TOP):
        found = Nodes.unpacked(pieces[root])
        below = found.child + np.int32(at)
        feature[root], cut[root], child[root] = found.feature[0], found.cut[0], below[0]
        parts.append((found.feature, found.cut, below, found.value))
        at += len(below)
    return Nodes(*[np.concatenate([x, *[p[i] for p in parts]]) for i, x in enumerate((feature, cut, child, value))])


def _weights(key: np.ndarray, tree: int, settings: Settings) -> np.ndarray:
    """How often a tree sees each row."""
    chance, upto = math.exp(-settings.row_rate), []
    for k in range(1, 30):
        upto.append((upto[-1] if upto else 0.0) + chance)
        chance *= settings.row_rate / k
    return np.searchsorted(upto, boosting.uniform(key, tree, settings.seed), side="right").astype(np.uint8)


def _drawn(seed: list[int], nodes: int, lane: _Lane) -> np.ndarray:
    """The features drawn for each node, in their order."""
    if lane.drawn >= lane.width:
        return np.broadcast_to(np.arange(lane.width), (nodes, lane.width))
    rank = np.random.default_rng(seed).random((nodes, lane.width), np.float32)
    return np.sort(np.argpartition(rank, lane.drawn, axis=1)[:, : lane.drawn], axis=1)


def _better(best: np.ndarray, feature: np.ndarray, cut: np.ndarray, gain: np.ndarray, node: np.ndarray, of: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Takes over the first of the largest gains of each node where it is larger; the gains' nodes are in order. Which were taken."""
    if not len(gain):
        return np.zeros(0, np.intp)
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    most = np.maximum.reduceat(gain, first)
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(node))))
    top = np.flatnonzero(gain == most[run])
    top = top[np.append(True, run[top][1:] != run[top][:-1])]
    top = top[gain[top] > best[node[top]]]
    at = node[top]
    best[at], feature[at], cut[at] = gain[top], of[at], code[top]
    return top


def _merged(codes: np.ndarray, weight: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the same codes and label as one, the first of them, with their weights added up: no split can part them."""
    wide = np.zeros((len(y), -(-codes.shape[1] // 8) * 8), np.uint8)
    wide[:, : codes.shape[1]] = codes
    words = np.column_stack((wide.view("<u8"), np.ascontiguousarray(y, "<f8").view("<u8")))
    mixed = np.zeros(len(y), np.uint64)
    for word in words.T:
        mixed = (mixed ^ word) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    words = words[order]
    first = np.flatnonzero(np.append(True, (words[1:] != words[:-1]).any(1)))
    if len(first) == len(y):
        return codes, weight, y
    total = np.add.reduceat(weight[order].astype(np.float64), first)
    kept = order[first]
    place = np.argsort(kept)
    kept = kept[place]
    return codes[kept], total[place], y[kept]


def grown(codes: np.ndarray, weight: np.ndarray, y: np.ndarray, lane: _Lane, depth: int, seed: list[int], settings: Settings) -> Nodes:
    """The whole tree of the rows given, level by level; `codes` has a row per row.

    Rows are sorted by (node, code) for each drawn feature, so a level costs the same for one node or many.
    """
    levels: list[tuple[np.ndarray, ...]] = []
    weight = weight.astype(np.float64)
    node, nodes, base = np.zeros(len(y), np.int64), 1, 0
    while nodes:
        wy = weight * y
        w, s, q = (np.bincount(node, x, nodes) for x in (weight, wy, wy * y))
        value = s / w
        feature, cut = np.full(nodes, -1, np.int64), np.zeros(nodes, np.int64)
        mixed = (q - s * value > lane.least_gain) & (w >= 2 * settings.least_rows) if depth < settings.depth else np.zeros(nodes, bool)
        if mixed.any():
            # Only rows of nodes that may be split go on.
            use = mixed[node]
            if not use.all():
                codes, weight, y, node, wy = codes[use], weight[use], y[use], node[use], wy[use]
            _split_all(codes, weight, wy, node, nodes, (w, s), _drawn([*seed, depth], nodes, lane), feature, cut, lane, settings)
        split = feature >= 0
        rank = np.cumsum(split) - split
        child = np.where(split, base + nodes + 2 * rank, base + np.arange(nodes))
        levels.append((np.where(split, feature, 0), np.where(split, cut, boosting.MISSING), child, np.where(split, 0.0, value + lane.centre)))
        base += nodes
        nodes = 2 * int(split.sum())
        if nodes:
            use = split[node]
            if not use.all():
                codes, weight, y, node = codes[use], weight[use], y[use], node[use]
            right = codes[np.arange(len(node)), feature[node]] > cut[node]
            node = 2 * rank[node] + right
        depth += 1
    return Nodes(*[np.concatenate(x).astype(kind) for x, kind in zip(zip(*levels), ("<i2", "u1", "<i4", "<f8"))])


def _split_all(codes, weight, wy, node, nodes, sums, drawn, feature, cut, lane: _Lane, settings: Settings) -> None:
    """Fills in the best split of each node (ties: the first feature, then the smallest code)."""
    n, width = codes.shape
    shift = max(int(n - 1).bit_length(), 1)
    flat, first, row = codes.reshape(-1), np.arange(n) * width, np.arange(n)
    held, held_s = np.bincount(node, weight, nodes), np.bincount(node, wy, nodes)
    before, before_s = np.cumsum(held) - held, np.cumsum(held_s) - held_s
    w, s = sums
    best = np.full(nodes, lane.least_gain)
    for slot in range(drawn.shape[1]):
        of = drawn[:, slot]
        key = (node * _CODES + flat[first + of[node]]) << shift | row
        key.sort()
        at, cell = key & ((1 << shift) - 1), key >> shift
        # The last row of each code that is not its node's last.
        last = np.flatnonzero(cell[1:] != cell[:-1])
        last = last[cell[last] // _CODES == cell[last + 1] // _CODES]
        owner = cell[last] // _CODES
        left, left_s = np.cumsum(weight[at])[last] - before[owner], np.cumsum(wy[at])[last] - before_s[owner]
        right, right_s = w[owner] - left, s[owner] - left_s
        gain = left_s**2 / left + right_s**2 / right - s[owner] ** 2 / w[owner]
        gain[(left < settings.least_rows) | (right < settings.least_rows)] = -np.inf
        _better(best, feature, cut, gain, owner, of, cell[last] % _CODES)


def _counts_job(state: DataFrame, lanes: dict[int, _Lane], tops: dict[int, list[_Top]], bins: int, settings: Settings) -> DataFrame:
    """Rows, weights and weighted labels per (open node, drawn feature, code) of each tree that has open nodes, as one array."""
    open_ = {lane: [t if t.open else None for t in own] for lane, own in tops.items()}

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[tuple[int, int], np.ndarray] = {}
        drawn: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for lane, y, key, codes, _ in boosting._unpacked(batch):
                codes, y = np.ascontiguousarray(codes.T), y - lanes[lane].centre
                for tree, top in enumerate(open_[lane]):
                    if top is None:
                        continue
                    weight = _weights(key, tree, settings)
                    place = np.full(len(top.feature), -1)
                    place[top.open] = np.arange(len(top.open))
                    use = np.flatnonzero(weight)
                    end = place[top.nodes().ends(codes[use])]
                    use, end = use[end >= 0], end[end >= 0]
                    at = lane, tree
                    if at not in counted:
                        drawn[at] = _open_drawn(lane, tree, top, lanes[lane], settings)
                        counted[at] = np.zeros((3, len(top.open), lanes[lane].drawn, bins + 1))
                    w = weight[use].astype(np.float64)
                    wy = w * y[use]
                    for slot in range(lanes[lane].drawn):
                        cell = end * (bins + 1) + np.minimum(codes[use, drawn[at][end, slot]], bins)
                        for plane, x in enumerate((None, w, wy)):
                            counted[at][plane, :, slot] += np.bincount(cell, x, len(top.open) * (bins + 1)).reshape(-1, bins + 1)
        part = TaskContext.get().partitionId()
        for (lane, tree), body in counted.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lane], pa.int32()), pa.array([tree], pa.int32()), pa.array([part], pa.int64()), pa.array([body.tobytes()], pa.binary())],
                names=["lane", "tree", partials.PART, partials.BODY],
            )

    return state.mapInArrow(job, f"lane int, tree int, {partials.PART} long, {partials.BODY} binary")


def _open_drawn(lane: int, tree: int, top: _Top, facts: _Lane, settings: Settings) -> np.ndarray:
    return np.concatenate([_drawn([settings.seed, lane + 1, tree, 0, node], 1, facts) for node in top.open])


def _decided(counts: DataFrame, lanes: dict[int, _Lane], tops: dict[int, list[_Top]], bins: int, settings: Settings) -> DataFrame:
    """The best split of each open node (feature -1: none), and rows, weight and labels of the node and of its left side."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lane, tree = (batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("lane", "tree"))
                facts, top = lanes[lane], tops[lane][tree]
                body = partials.array_of(batch.column(batch.schema.get_field_index(partials.BODY))[i].as_buffer())
                counted = body.reshape(3, len(top.open), facts.drawn, bins + 1)
                drawn = _open_drawn(lane, tree, top, facts, settings)
                whole = counted[:, :, 0].sum(2)
                n = len(top.open)
                feature, cut, best = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.full(n, facts.least_gain)
                sides = np.zeros((3, n))
                for slot in range(facts.drawn):
                    left = np.cumsum(counted[:, :, slot], axis=2)[:, :, :-1]
                    right = whole[:, :, None] - left
                    fits = (left[0] > 0) & (right[0] > 0) & (left[1] >= settings.least_rows) & (right[1] >= settings.least_rows)
                    # A code no row has ends where the one before it does: only codes of rows stand for a split.
                    fits &= counted[0, :, slot, :-1] > 0
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = left[2] ** 2 / left[1] + right[2] ** 2 / right[1] - (whole[2] ** 2 / whole[1])[:, None]
                    gain = np.where(fits, gain, -np.inf)
                    owner = np.repeat(np.arange(n), bins)
                    taken = _better(best, feature, cut, gain.reshape(-1), owner, drawn[:, slot], np.tile(np.arange(bins), n))
                    sides[:, owner[taken]] = left.reshape(3, -1)[:, taken]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lane], pa.int32()), pa.array([tree], pa.int32()), pa.array([feature.astype("<f8").tobytes()], pa.binary()),
                     pa.array([cut.astype("<f8").tobytes()], pa.binary()), pa.array([np.stack((whole, sides)).tobytes()], pa.binary())],
                    names=["lane", "tree", "feature", "cut", "sums"],
                )

    return counts.mapInArrow(job, _DECIDED)


def _grow_tops(state: DataFrame, lanes: dict[int, _Lane], tops: dict[int, list[_Top]], bins: int, settings: Settings) -> None:
    """Splits open nodes level by level until all are small or leaves."""
    n_parts = state.rdd.getNumPartitions()
    while any(t.open for own in tops.values() for t in own):
        counts = partials.summed(_counts_job(state, lanes, tops, bins, settings), ["lane", "tree"], n_parts)
        seen = set()
        for row in _decided(counts, lanes, tops, bins, settings).collect():
            top, centre = tops[row["lane"]][row["tree"]], lanes[row["lane"]].centre
            seen.add((row["lane"], row["tree"]))
            feature, cut = (partials.array_of(row[c]).astype(int).tolist() for c in ("feature", "cut"))
            sums = partials.array_of(row["sums"]).reshape(2, 3, -1)
            todo, top.open = top.open, []
            for i, node in enumerate(todo):
                (n, w, s), left = sums[0, :, i].tolist(), sums[1, :, i].tolist()
                if feature[i] < 0:
                    top.value[node] = s / w + centre if w else math.nan
                    continue
                depth = top.depth[node] + 1
                top.feature[node], top.cut[node], top.child[node] = feature[i], cut[i], top.add(depth)
                top.add(depth)
                for side, (rows, weight, labels) in enumerate((left, (n - left[0], w - left[1], s - left[2]))):
                    end = top.child[node] + side
                    if depth >= settings.depth:
                        top.value[end] = labels / weight + centre
                    else:
                        (top.open if rows > _LOCAL_ROWS else top.small).append(end)
        for lane, own in tops.items():
            for tree, top in enumerate(own):
                if top.open and (lane, tree) not in seen:
                    # No row of the table was drawn for this tree.
                    top.value[0], top.open = math.nan, []


def _chunks(state: DataFrame, lanes: dict[int, _Lane], tops: dict[int, list[_Top]], settings: Settings) -> DataFrame:
    """The rows of small nodes, packed by block and node."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        names = [c.split()[0] for c in _CHUNKS.split(", ")]
        kinds = [pa.int32()] * 3 + [pa.int64()] + [pa.binary()] * 3
        for batch in batches:
            for lane, y, key, codes, _ in boosting._unpacked(batch):
                codes, y = np.ascontiguousarray(codes.T), (y - lanes[lane].centre).astype("<f8")
                found: list[tuple] = []
                for tree, top in enumerate(tops[lane]):
                    if not top.small:
                        continue
                    weight = _weights(key, tree, settings)
                    use = np.flatnonzero(weight)
                    end = top.nodes().ends(codes[use])
                    small = np.isin(end, top.small)
                    use, end = use[small], end[small]
                    order = np.argsort(end, kind="stable")
                    roots, first = np.unique(end[order], return_index=True)
                    for root, rows in zip(roots.tolist(), np.split(use[order], first[1:])):
                        place += 1
                        found.append((lane, tree, root, place, weight[rows].tobytes(), y[rows].tobytes(), codes[rows].tobytes()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found), kinds)], names=names)

    return state.mapInArrow(job, _CHUNKS)


def _pieces(chunks: DataFrame, lanes: dict[int, _Lane], tops: dict[int, list[_Top]], settings: Settings) -> DataFrame:
    depths = {(lane, tree): top.depth for lane, own in tops.items() for tree, top in enumerate(own)}

    def grow(rows: pa.Table) -> pa.Table:
        lane, tree, root = (rows.column(c)[0].as_py() for c in ("lane", "tree", "root"))
        # The blocks' order, so sums do not depend on which arrived first.
        order = np.argsort(rows.column("place").to_numpy(), kind="stable").tolist()
        weight, label, codes = (
            np.concatenate([np.frombuffer(rows.column(c)[i].as_buffer(), kind) for i in order])
            for c, kind in (("weight", np.uint8), ("label", "<f8"), ("codes", np.uint8))
        )
        facts = lanes[lane]
        found = grown(
            *_merged(codes.reshape(len(label), facts.width), weight, label), facts, depths[lane, tree][root],
            [settings.seed, lane + 1, tree, 1, root], settings,
        )
        return pa.table({
            **{c: rows.column(c).slice(0, 1) for c in ("lane", "tree", "root")}, "body": pa.array([found.packed()], pa.binary()),
        })

    return chunks.groupBy("lane", "tree", "root").applyInArrow(grow, _PIECES)


@dataclass
class Found:
    """What a fit leaves of one lane: ends of the bins, the labels' mean, and the table of its trees."""

    edges: list[np.ndarray]
    base: float
    trees: int
    pieces: DataFrame
    task: str


def fit(lanes: DataFrame, settings: Settings, task: str = "binary") -> dict[int, Found]:
    """A forest per lane of a table ``lane int, key long, label double, features array<double>``.

    A blank feature is NaN and lies above all values. Rows without a label are an error. A lane without rows has no forest.
    """
    # Rows that share a key are drawn by themselves unless they are the same.
    key = F.xxhash64("key", "label", "features").alias("key")
    lanes = written(lanes.select(F.col("lane").cast("int").alias("lane"), key, "label", "features"), "forest-rows")
    facts = boosting.lane_facts(lanes)
    if not facts:
        return {}
    if task == "binary" and any(row["other"] for row in facts):
        raise TrainingError("a forest of a binary task needs labels 0 and 1")
    edges = boosting.bin_edges(lanes, settings.bins)
    known: dict[int, _Lane] = {}
    tops: dict[int, list[_Top]] = {}
    for row in facts:
        lane, width = row["lane"], row["most"]
        centre = 0.0 if task == "binary" else float(np.float32(row["mean"]))
        known[lane] = _Lane(width, settings.drawn(width, task), centre, max(_LEAST_GAIN * row["variance"], 1e-300))
        large = row["rows"] > _LOCAL_ROWS and settings.depth > 0
        tops[lane] = [_Top(open=[0] if large else [], small=[] if large else [0]) for _ in range(settings.trees)]
    bins = max(max(map(len, e)) for e in edges.values())
    packed, cores = boosting._blocks(lanes, edges, dict.fromkeys(edges, 0.0)), lanes.sparkSession.sparkContext.defaultParallelism
    packed = packed.repartition(cores) if lanes.rdd.getNumPartitions() < cores else packed
    state = blocks(packed, "forest-state")
    _grow_tops(state, known, tops, max(bins, 1), settings)
    below = _pieces(_chunks(state, known, tops, settings), known, tops, settings)
    upper = []
    for lane, own in tops.items():
        for tree, top in enumerate(own):
            for node in top.small:
                # Kept only if no row comes here.
                top.value[node] = math.nan
            upper.append((lane, tree, _TOP, bytearray(top.nodes().packed())))
    pieces = written(below.unionByName(lanes.sparkSession.createDataFrame(upper, _PIECES)), "forest-trees")
    return {
        row["lane"]: Found(edges[row["lane"]], row["mean"], settings.trees, pieces.filter(F.col("lane") == row["lane"]).drop("lane"), task)
        for row in facts
    }
