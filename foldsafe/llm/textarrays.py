"""Texts of an Arrow batch as flat byte arrays: words, lines and their hashes without loops over rows.

Used inside `mapInArrow` tasks. A word is a run of bytes other than ASCII white space
(0x20, 0x09-0x0D), so UTF-8 characters are never cut. Hashes are 64-bit and depend on the bytes
alone: they are the same in every task, run and machine. Memory per task is bounded by the chunk
size, or by the longest single text where that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CONTINUES = (np.arange(256) & 0xC0) == 0x80
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def combine(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of ordered pairs of hashes."""
    return mix(first * _BASE + np.asarray(second, np.uint64) + np.uint64(0x2545F4914F6CDD1D))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
WORD_TABLE = np.where(SPACE, np.uint64(0), _BYTE)
LOWER_TABLE = WORD_TABLE.copy()
LOWER_TABLE[65:91] = WORD_TABLE[97:123]
LINE_TABLE = _BYTE.copy()
LINE_TABLE[0x0A] = 0
SPAN_TABLE = _BYTE
_STEP = 0xD1342543DE82EF95
# Bytes hashed at a time: their powers stay in a core's cache.
_SEGMENT = 1 << 16


def _powers_of(step: int, length: int) -> np.ndarray:
    steps = np.full(length, np.uint64(step))
    steps[0] = 1
    return np.multiply.accumulate(steps)


# Powers of the step and of its inverse: a span's sum may begin at any power and be brought back.
_powers, _back = (_powers_of(x, _SEGMENT) for x in (_STEP, pow(_STEP, -1, 1 << 64)))


class Texts:
    """Some rows' texts: `data` holds their bytes, row i is `data[offsets[i]:offsets[i + 1]]`."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def row_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def sums(self, marks: np.ndarray) -> np.ndarray:
        """How many of the marked bytes each row has."""
        run = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        return run[self.offsets[1:]] - run[self.offsets[:-1]]

    def spaces(self) -> np.ndarray:
        return SPACE[self.data]

    def characters(self) -> np.ndarray:
        """Marks the first byte of every code point."""
        return ~_CONTINUES[self.data]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """First byte and row of every word, in order."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        space = self.spaces()
        begins = ~space
        begins[1:] &= space[:-1]
        heads = self.offsets[:-1]
        heads = heads[heads < len(self.data)]
        begins[heads] = ~space[heads]
        starts = np.flatnonzero(begins)
        return starts, np.repeat(np.arange(len(self)), np.diff(np.searchsorted(starts, self.offsets)))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte, end (without the line break) and row of every non-empty span between line breaks."""
        if not len(self.data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        begins = np.zeros(len(self.data) + 1, bool)
        begins[self.offsets[:-1]] = True
        begins[1:] |= self.data == 0x0A
        starts = np.flatnonzero(begins[:-1])
        ends = np.append(starts[1:], len(self.data))
        ends = ends - (self.data[ends - 1] == 0x0A)
        return starts, ends, self.row_of(starts)

    def hashes(self, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Hash of each span from one start to the next; bytes the table maps to 0 must come last in a span."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        ends = np.append(starts[1:], len(self.data))
        total = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            low = int(starts[i])
            j = max(int(np.searchsorted(ends, low + _SEGMENT, side="right")), i + 1)
            high, places = int(ends[j - 1]), starts[i:j] - low
            values = table[self.data[low:high]]
            if high - low > _SEGMENT:
                # One long span.
                total[i] = (values * _powers_of(_STEP, high - low)).sum(dtype=np.uint64)
            else:
                total[i:j] = np.add.reduceat(values * _powers[: high - low], places) * _back[places]
            i = j
        return mix(total)

    def text(self, row: int) -> str:
        return self.data[self.offsets[row]: self.offsets[row + 1]].tobytes().decode("utf-8", "replace")


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, Texts]]:
    """The texts of a string column (null: empty) in order, at most `limit` bytes at a time or one row."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    _, places, body = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset: column.offset + n + 1]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        until = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        until = min(n, max(until, row + 1))
        low, high = int(offsets[row]), int(offsets[until])
        yield row, Texts(data[low:high], offsets[row: until + 1] - low)
        row = until
