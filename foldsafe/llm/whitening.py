"""Whitening by Jacobi-Davidson: leading eigenvectors of a covariance that is never formed.

Vectors are rows of whole numbers (quantised embeddings), so their sums are exact. The covariance only acts:
one pass over the rows centres each block, multiplies it with a few columns and the result with the block
again, and the partial products are added up in a fixed order. On the driver lie only a few columns of as many numbers as a
vector has.

The eigenvectors come from a growing orthonormal subspace. Each round

1. takes the Ritz pairs of the subspace (Rayleigh-Ritz),
2. locks those whose residual has reached double precision,
3. solves, for all others at once, the correction equation
   (I - QQ')(V - e I)(I - QQ') t = -r  by some steps of MINRES, where Q are all Ritz vectors wanted, so one pass
   over the rows serves a step of every pair,
4. adds the corrections to the subspace, which is cut back to its best Ritz vectors where it gets too wide.

A subspace as wide as the vectors is the whole space, and its Ritz pairs are final.

Vectors that are null, empty or hold a null take no part; an error tells of vectors of different lengths. Repeated
rows count as often as they occur. Components whose eigenvalue is rounding error (constant or dependent entries, fewer
rows than entries) cannot be whitened and have no rows; so has an empty table. Key columns pass through, other columns are not
read, and keys must not be called like results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsafe.errors import SchemaError
from foldsafe.operators import partials
from foldsafe.sources import scratch

COMPONENTS = 32
INNER_STEPS = 6
_BLOCK_ROWS = 4096
_MOST_ROUNDS = 200
_SEED = 20
_EPSILON = float(np.finfo(np.float64).eps)
_PARTS = f"{partials.PART} long, {partials.BODY} binary"
_RESULT = [
    T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
    T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
    T.StructField("identity_error", T.DoubleType()),
]


@dataclass(frozen=True)
class Whitening:
    """What a fit learns: the number of vectors and their exact sums, unit `axes` (a column each) with their
    eigenvalues from large to small, the residuals those were found with, the covariance's trace, and how far the
    whitened vectors' covariance is from the identity."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    trace: float
    identity_error: float
    passes: int


def usable(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector takes part."""
    v = F.col(f"`{vector}`")
    return df.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull()))


def fit(df: DataFrame, vector: str, components: int = COMPONENTS, inner: int = INNER_STEPS, widest: int | None = None) -> Whitening:
    """Learn from all usable vectors. ``widest`` bounds the subspace (at least three times ``components`` unless given)."""
    rows = usable(df.select(F.col(f"`{vector}`").cast("array<long>").alias("v")), "v")
    sizes = rows.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v"))).first()
    n, width = sizes[0], sizes[1] or 0
    if sizes[1] != sizes[2]:
        raise SchemaError(f"vectors of {sizes[1]} to {sizes[2]} entries cannot be whitened together")
    if not n:
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0.0, 0.0, 0)
    found = rows.select(F.posexplode("v").alias("place", "x")).groupBy("place").agg(F.sum("x").alias("s")).collect()
    sums = tuple(r["s"] for r in sorted(found, key=lambda r: r["place"]))
    covariance = _Covariance(rows, n, sums)
    axes, values, residuals = _jacobi_davidson(covariance, width, min(components, width), inner, widest)
    # What is left of dependent directions is rounding error.
    real = values > 16 * width * _EPSILON * (values[0] if len(values) else 0.0)
    axes, values, residuals = axes[:, real], values[real], residuals[real]
    error = covariance.identity_error(axes, values) if len(values) else 0.0
    return Whitening(n, sums, axes, values, residuals, covariance.trace, error, covariance.passes)


def transform(df: DataFrame, model: Whitening, vector: str, keys: Sequence[str]) -> DataFrame:
    """A row per usable vector and component: the keys, `component` (from 1), `n`, `deviation` (the sum of
    (n * x - sum)^2 over the entries, exact), `whitened`, `explained` (of the trace) and `identity_error`."""
    clash = {f.name for f in _RESULT} & set(keys)
    if clash:
        raise SchemaError(f"key columns cannot be called {sorted(clash)}")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([T.StructField(k, kinds[k]) for k in keys] + _RESULT)
    picked = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{vector}`").cast("array<long>").alias("_whitened_vector"))
    picked = usable(picked, "_whitened_vector")
    n, k, order = model.n, len(model.values), schema.names
    if not k:
        return df.sparkSession.createDataFrame([], schema)
    base, rest = _centre(n, model.sums)
    scaled = model.axes / np.sqrt(model.values)
    shares = model.values / model.trace
    error = model.identity_error
    sums = np.array(model.sums, np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, _BLOCK_ROWS):
                part = batch.slice(first, _BLOCK_ROWS)
                x = _matrix(part.column(len(keys)), len(sums))
                values = (x - base - rest) @ scaled
                deviation = _deviations(x, n, sums)
                taken = pa.array(np.repeat(np.arange(len(x)), k))
                columns = [part.column(i).take(taken) for i in range(len(keys))]
                columns += [
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, n, np.int64)), pa.array(np.repeat(deviation, k)),
                    pa.array(values.ravel()), pa.array(np.tile(shares, len(x))), pa.array(np.full(len(x) * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=order)

    return picked.mapInArrow(task, schema)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Sums of squares in 64-bit integers, or an error where they would not fit."""
    largest = float(np.abs(n * x.astype(np.float64) - sums).max(initial=0.0))
    if len(sums) * largest * largest >= 2.0**63 or n * float(np.abs(x).max(initial=0)) >= 2.0**62:
        raise OverflowError("deviations do not fit a 64-bit integer")
    moved = n * x - sums
    return (moved * moved).sum(1)


def _centre(n: int, sums: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as a whole number and a fraction: both are exact to the last digit of a double."""
    base = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return base, rest


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


class _Covariance:
    """The covariance as an action on columns. The rows are written once, less the whole part of the mean."""

    def __init__(self, rows: DataFrame, n: int, sums: tuple[int, ...]):
        self.n, self.passes, self.trace = n, 0, 0.0
        base, self._rest = _centre(n, sums)
        width = len(sums)

        def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, batch.num_rows, _BLOCK_ROWS):
                    x = _matrix(batch.column(0).slice(first, _BLOCK_ROWS), width) - base
                    small = np.abs(x).max(initial=0) < 2**31
                    body = x.astype("<i4" if small else "<i8").tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([4 if small else 8]), pa.array([body], pa.binary())], names=["bytes", "x"]
                    )

        self._blocks = scratch.written(rows.mapInArrow(block, "bytes long, x binary"), "whitening-blocks")
        self._parts = self._blocks.rdd.getNumPartitions()

    def _sum(self, of) -> np.ndarray:
        """The sum over all blocks of an array made from a centred block."""
        rest = self._rest

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for size, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                    x = np.frombuffer(body.as_buffer(), f"<i{size}").reshape(-1, len(rest))
                    part = of(x - rest)
                    total = part if total is None else total + part
            if total is not None:
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int64()), pa.array([total.astype("<f8").tobytes()], pa.binary())],
                    names=[partials.PART, partials.BODY],
                )

        self.passes += 1
        return partials.collected(self._blocks.mapInArrow(task, _PARTS), self._parts)

    def __call__(self, columns: np.ndarray) -> np.ndarray:
        def product(z: np.ndarray) -> np.ndarray:
            return np.append((z.T @ (z @ columns)).ravel(), np.einsum("ij,ij->", z, z))

        found = self._sum(product) / self.n
        self.trace = float(found[-1])
        return found[:-1].reshape(columns.shape)

    def identity_error(self, axes: np.ndarray, values: np.ndarray) -> float:
        """The largest absolute entry of the whitened rows' covariance less the identity."""
        scaled = axes / np.sqrt(values)
        k = len(values)

        def moments(z: np.ndarray) -> np.ndarray:
            w = z @ scaled
            return np.append((w.T @ w).ravel(), w.sum(0))

        found = self._sum(moments) / self.n
        mean = found[k * k:]
        return float(np.abs(found[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def _jacobi_davidson(product, width: int, wanted: int, inner: int, widest: int | None):
    """The leading eigenvectors, eigenvalues and residual norms of a symmetric matrix given by its product with columns."""
    widest = min(width, max(widest or 3 * wanted, 2 * wanted))
    random = np.random.default_rng(_SEED)
    basis = np.linalg.qr(random.standard_normal((width, min(width, wanted + 8))))[0]
    moved = product(basis)
    best = np.inf
    for _ in range(_MOST_ROUNDS):
        values, turn = np.linalg.eigh(_symmetric(basis.T @ moved))
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = basis @ turn[:, :wanted], moved @ turn[:, :wanted]
        left = image - ritz * values[:wanted]
        norms = np.linalg.norm(left, axis=0)
        locked = norms <= 16 * _EPSILON * np.sqrt(width) * max(values[0], 0.0)
        if locked.all() or basis.shape[1] == width:
            break
        # Rounding in the products sets a floor that may lie a little above the aim: no progress there is the end.
        if norms.max() <= 1e-12 * values[0] and norms.max() > best / 2:
            break
        best = min(best, norms.max())
        if basis.shape[1] + (~locked).sum() > widest:
            keep = max(wanted, min(widest - int((~locked).sum()), 2 * wanted))
            basis, moved = basis @ turn[:, :keep], moved @ turn[:, :keep]
        steps = _corrections(product, ritz, values[:wanted][~locked], left[:, ~locked], inner)
        fresh = _orthogonal(basis, steps, random)
        basis, moved = np.hstack((basis, fresh)), np.hstack((moved, product(fresh)))
    # Measured once more on the vectors themselves.
    ritz = np.linalg.qr(ritz)[0]
    image = product(ritz)
    values, turn = np.linalg.eigh(_symmetric(ritz.T @ image))
    values, turn = values[::-1], turn[:, ::-1]
    ritz, image = ritz @ turn, image @ turn
    return ritz, values, np.linalg.norm(image - ritz * values, axis=0)


def _symmetric(matrix: np.ndarray) -> np.ndarray:
    return (matrix + matrix.T) / 2


def _orthogonal(basis: np.ndarray, steps: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """New unit columns at right angles to the basis and to each other; one that adds nothing is drawn anew."""
    room = min(steps.shape[1], basis.shape[0] - basis.shape[1])
    fresh = np.zeros((basis.shape[0], 0))
    for i in range(room):
        column = steps[:, i]
        while True:
            size = np.linalg.norm(column)
            for _ in range(3):
                column = column - basis @ (basis.T @ column) - fresh @ (fresh.T @ column)
            if np.linalg.norm(column) > 1e-8 * size > 0:
                break
            column = random.standard_normal(len(column))
        fresh = np.column_stack((fresh, column / np.linalg.norm(column)))
    return fresh


def _corrections(product, ritz: np.ndarray, values: np.ndarray, left: np.ndarray, steps: int) -> np.ndarray:
    """MINRES on all correction equations side by side, a pass over the rows per step."""

    def project(x: np.ndarray) -> np.ndarray:
        return x - ritz @ (ritz.T @ x)

    def act(x: np.ndarray) -> np.ndarray:
        x = project(x)
        return project(product(x) - x * values)

    v = project(-left)
    beta = np.linalg.norm(v, axis=0)
    safe = np.where(beta > 0, beta, 1.0)
    v, before = v / safe, np.zeros_like(v)
    answer, w, w_before = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    rhs, last_beta = beta.copy(), np.zeros_like(beta)
    cos, cos_before, sin, sin_before = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        image = act(v)
        alpha = (v * image).sum(0)
        following = image - v * alpha - before * last_beta
        following -= v * (v * following).sum(0)
        next_beta = np.linalg.norm(following, axis=0)
        # Two old rotations act on the new column of the tridiagonal matrix, then a new one clears what is below.
        far = sin_before * last_beta
        near = cos * cos_before * last_beta + sin * alpha
        here = cos * alpha - sin * cos_before * last_beta
        size = np.hypot(here, next_beta)
        good = size > 0
        size = np.where(good, size, 1.0)
        new_cos, new_sin = np.where(good, here / size, 1.0), np.where(good, next_beta / size, 0.0)
        w, w_before = np.where(good, (v - w * near - w_before * far) / size, 0.0), w
        answer = answer + w * (new_cos * rhs)
        rhs = -new_sin * rhs
        cos_before, sin_before, cos, sin = cos, sin, new_cos, new_sin
        before, last_beta = v, next_beta
        v = following / np.where(next_beta > 0, next_beta, 1.0)
    return project(answer)
