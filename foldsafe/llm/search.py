"""Exact top-k search by inner product: KD-trees per shard, best-first, with a propagated k-th score.

Vectors become integers, floor(`SCALE` * component). A top tree of median splits, fitted on at most
`SAMPLE_ROWS` rows (the rows with the smallest id hashes), cuts space into at most `MOST_CELLS` cells;
every row is placed, and tight bounding boxes of the cells come from all rows. A cell of more than
`SHARD_ROWS` rows is dealt over several shards, so copies of one vector never gather. In a shard a
KD-tree of median splits with tight boxes is searched best-first: the box with the highest possible
score is opened next, until none can beat the k-th score found.

Queries visit one cell first, the one whose box promises most. The k-th score found there goes along
to the second visit, of all other cells whose box can still reach it. Queries meet shards in blocks of
about `QUERY_ROWS`: a shard is repeated for each block, so memory per task is bounded on both sides.
The fit on a sample affects only speed; the result is exact.

A vector that is null, empty, or holds a null or non-finite component takes no part. Shorter vectors
count as padded with zeros. A query's own row is any row with its id; of several query rows with one
id the smallest vector counts. Other repeated rows are candidates of their own; ties go to the smaller
id. Fewer candidates than k: all are returned. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldsafe.sources import scratch

SCALE = 1024
SAMPLE_ROWS = 10_000
MOST_CELLS = 256
CELL_ROWS = 4096
SHARD_ROWS = 8192
QUERY_ROWS = 2048
LEAF_ROWS = 128
_EXACT = 2.0**52


class Tree:
    """A KD-tree over integer vectors: nodes in arrays, leaves are ranges of the reordered rows."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.arange(len(points))
        self.low, self.high, self.left, self.right, self.range = [], [], [], [], []
        self._split(points, order, 0, len(points), leaf)
        self.points, self.ids = points[order], ids[order]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.most = int(np.abs(points).max(initial=0))

    def _split(self, points: np.ndarray, order: np.ndarray, first: int, last: int, leaf: int) -> int:
        own = points[order[first:last]]
        node = len(self.range)
        low, high = own.min(axis=0), own.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.range.append((first, last))
        self.left.append(-1)
        self.right.append(-1)
        wide = int(np.argmax(high - low))
        if last - first > leaf and high[wide] > low[wide]:
            middle = (last - first) // 2
            order[first:last] = order[first:last][np.argpartition(own[:, wide], middle)]
            self.left[node] = self._split(points, order, first, first + middle, leaf)
            self.right[node] = self._split(points, order, first + middle, last, leaf)
        return node

    def bounds(self, query: np.ndarray, nodes: list[int]) -> np.ndarray:
        return best_possible(query, self.low[nodes], self.high[nodes])

    def top(self, query: np.ndarray, own: int, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k points that reach the floor, best first, ties by id."""
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting = [(-int(self.bounds(query, [0])[0]), 0)]
        small = self.most * float(np.abs(query).max(initial=0)) * len(query) < _EXACT
        while waiting and (floor is None or -waiting[0][0] >= floor):
            _, node = heapq.heappop(waiting)
            if self.left[node] >= 0:
                children = [self.left[node], self.right[node]]
                for bound, child in zip(self.bounds(query, children).tolist(), children):
                    if floor is None or bound >= floor:
                        heapq.heappush(waiting, (-bound, child))
                continue
            first, last = self.range[node]
            block = self.points[first:last]
            if small:
                found = (block.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
            else:
                found = block @ query
            keep = self.ids[first:last] != own
            if floor is not None:
                keep &= found >= floor
            if keep.any():
                ids = np.concatenate((ids, self.ids[first:last][keep]))
                scores = np.concatenate((scores, found[keep]))
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    floor = int(scores[-1]) if floor is None else max(floor, int(scores[-1]))
        return ids, scores


def best_possible(query: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The highest inner product that a point in each box could have."""
    return np.where(query > 0, high * query, low * query).sum(axis=1)


def top_tree(sample: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """Median splits of a sample as a heap of (dimension, least value of the upper side)."""
    splits = [(0, 0)] * (2**depth - 1)
    parts = {0: sample}
    for node in range(len(splits)):
        own = parts.pop(node)
        wide, value = 0, 0
        if len(own):
            wide = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            value = int(np.partition(own[:, wide], len(own) // 2)[len(own) // 2])
        splits[node] = (wide, value)
        upper = own[:, wide] >= value
        parts[2 * node + 1], parts[2 * node + 2] = own[~upper], own[upper]
    return splits


def _dense(column: pa.Array, width: int) -> np.ndarray:
    """List column as a matrix, short rows padded with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _packed(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in matrix.astype("<i8")], pa.binary())


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, width)


def _placed(points: DataFrame, width: int, splits: list[tuple[int, int]], depth: int) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, values = (np.array(x, np.int64) for x in zip(*splits)) if splits else (None, None)
        for batch in batches:
            matrix = _dense(batch.column(2), width)
            node = np.zeros(len(matrix), np.int64)
            for _ in range(depth):
                upper = matrix[np.arange(len(matrix)), dims[node]] >= values[node]
                node = 2 * node + 1 + upper
            cell = node - (2**depth - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cell), _packed(matrix)],
                names=["id", "is_query", "cell", "vector"],
            )

    placed = points.mapInArrow(task, "id long, is_query boolean, cell long, vector binary")
    return scratch.written(placed.withColumn("row", F.monotonically_increasing_id()), "search-cells")


def _boxes(placed: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells that have rows, their sizes and their tight boxes; at most `MOST_CELLS` of them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes: dict[int, list] = {}
        for batch in batches:
            cells, matrix = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            for cell in np.unique(cells).tolist():
                own = matrix[cells == cell]
                box = boxes.setdefault(cell, [0, own[0], own[0]])
                boxes[cell] = [box[0] + len(own), np.minimum(box[1], own.min(axis=0)), np.maximum(box[2], own.max(axis=0))]
        rows = [(c, d, n, int(lo[d]), int(hi[d])) for c, (n, lo, hi) in boxes.items() for d in range(width)]
        names = ["cell", "dim", "n", "low", "high"]
        for i in range(0, len(rows), 10_000):
            part = list(zip(*rows[i: i + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in part], names=names)

    parts = placed.select("cell", "vector").mapInArrow(task, "cell long, dim long, n long, low long, high long")
    found = parts.groupBy("cell", "dim").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    table = found.toArrow().sort_by([("cell", "ascending"), ("dim", "ascending")])
    cell, n, low, high = (table.column(c).to_numpy().reshape(-1, width) for c in ("cell", "n", "low", "high"))
    return cell[:, 0], n[:, 0], low, high


def _routes(queries: DataFrame, width: int, cells, low, high, first: bool) -> DataFrame:
    """Pairs of a query and a cell to visit: the most promising one, or the others that can reach `floor`."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(batch.column(1), width)
            floors = batch.column(2).to_pylist()
            rows, targets = [], []
            for i, query in enumerate(matrix):
                bounds = best_possible(query, low, high)
                home = int(np.argmax(bounds))
                if first:
                    chosen = [home]
                else:
                    chosen = [c for c in range(len(cells)) if c != home and (floors[i] is None or bounds[c] >= floors[i])]
                rows += [i] * len(chosen)
                targets += [int(cells[c]) for c in chosen]
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [taken.column(0), taken.column(1), taken.column(2), pa.array(targets, pa.int64())],
                names=["query_id", "query", "floor", "cell"],
            )

    return queries.select("query_id", "query", "floor").mapInArrow(task, "query_id long, query binary, floor long, cell long")


def _visit(pairs: DataFrame, placed: DataFrame, sizes: dict[int, int], width: int, k: int) -> DataFrame:
    """The best k of each pair's cell, by trees over its shards."""
    spark = pairs.sparkSession
    asked = {r["cell"]: r["n"] for r in pairs.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = [(c, -(-sizes[c] // SHARD_ROWS), -(-n // QUERY_ROWS)) for c, n in asked.items()]
    # One row per cell, at most MOST_CELLS.
    deals = F.broadcast(spark.createDataFrame(rows, "cell long, shards long, blocks long"))
    points = placed.join(deals, "cell").select(
        "cell", (F.col("row") % F.col("shards")).alias("shard"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "id", "vector",
    )
    queries = pairs.join(deals, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"),
        F.pmod(F.xxhash64("query_id"), F.col("blocks")).alias("block"), "query_id", "query", "floor",
    )
    key = ["cell", "shard", "block"]

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            tree = Tree(_matrix(left.column("vector"), width), left.column("id").to_numpy())
            asks = _matrix(right.column("query"), width)
            floors = right.column("floor").to_pylist()
            for i, own in enumerate(right.column("query_id").to_pylist()):
                ids, scores = tree.top(asks[i], own, k, floors[i])
                out += [(own, v, s) for v, s in zip(ids.tolist(), scores.tolist())]
        columns = list(zip(*out)) if out else [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    grouped = points.groupBy(*key).cogroup(queries.groupBy(*key))
    return grouped.applyInArrow(task, "query_id long, vec_id long, score long")


def nearest(
    df: DataFrame, is_query: Column, k: int = 10, identity: str = "vec_id", vector: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """`query_id`, `rank`, `vec_id` and `score` of each query row's k best other rows."""
    values = F.col(f"`{vector}`")
    limit = F.lit(float("inf"))
    usable = (F.size(values) > 0) & F.forall(
        values, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < limit)
    )
    rows = df.where(values.isNotNull() & F.col(f"`{identity}`").isNotNull()).where(usable).select(
        F.col(f"`{identity}`").cast("long").alias("id"),
        is_query.alias("is_query"),
        F.transform(values, lambda x: F.floor(x.cast("double") * scale)).alias("vector"),
    )
    points = scratch.written(rows, "search-points")
    count, width = points.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    spark = df.sparkSession
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    depth = min(MOST_CELLS, max(1, -(-count // CELL_ROWS)) * 2 - 1).bit_length() - 1
    sample = points.select("vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toArrow()
    column = sample.column("vector").combine_chunks()
    splits = top_tree(_dense(column, width), depth)
    placed = _placed(points, width, splits, depth)
    cells, sizes, low, high = _boxes(placed, width)
    size_of = dict(zip(cells.tolist(), sizes.tolist()))
    asked = placed.where("is_query").groupBy(F.col("id").alias("query_id")).agg(F.min("vector").alias("query"))
    asked = asked.withColumn("floor", F.lit(None).cast("long"))
    near = scratch.written(_visit(_routes(asked, width, cells, low, high, True), placed, size_of, width, k), "search-near")
    # The k-th score of the first visit; a cell of several shards gives more rows, of which the k-th counts.
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = near.withColumn("place", F.row_number().over(best)).where(F.col("place") == k).select("query_id", F.col("score").alias("floor"))
    again = asked.drop("floor").join(kth, "query_id", "left").select("query_id", "query", "floor")
    pairs = scratch.written(_routes(again, width, cells, low, high, False), "search-pairs")
    far = _visit(pairs, placed, size_of, width, k)
    ranked = near.unionByName(far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
