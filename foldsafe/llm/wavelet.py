"""Token ids on disk as wavelet matrices: compressed shards that answer queries without being unpacked.

A shard holds the ids of consecutive documents. Its matrix has one plane of bits per binary digit of an id, from the
highest: each plane lists that digit of every id, and puts ids with a 0 before ids with a 1 for the next plane. With
a running count of ones per 512 bits, a plane answers rank (ones before a place) at once, and from ranks follow

* access: the id at a place, one rank per plane,
* counting: how often an id occurs in a range, two ranks per plane,
* look-up: where the k-th occurrence of an id is, one search per plane, from the last plane up.

Ids of 16 digits take 2 bytes and a sixteenth, against 4 in plain form.

`write` deals documents out by ranges of their id, encodes them in that order and writes the shards as binary rows
of Parquet files, one file or more per range. Spark's own writer commits them: a lost executor's files are made again, any
file system will do. A second small table has the place of each range in the whole. `open_index` reads both back; `documents`,
`tokens_at`, `counts` and `occurrences` work on what was read alone.

Null and empty texts are a single closing id. A null document id comes first. Rows with the same id are in the order of
their texts' hashes; ranges are cut by id, hash and place in the table, so neither a repeated id nor a repeated row fills one task. An
empty table gives an index without shards. Other columns are not read. A task holds one shard: `shard_tokens`
ids and the document that goes over.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsafe.llm import encoding, textarrays
from foldsafe.llm.packing import with_closing

SHARD_TOKENS = 1 << 20
CLOSING_ID = 1
_HEAD = struct.Struct("<4sIQ")
_MAGIC = b"WVM1"
_RANK_BITS = 512
_RANK_WORDS = _RANK_BITS // 64


class Matrix:
    """A wavelet matrix over 32-bit ids, read from its bytes without copying them.

    Format, all little-endian: `WVM1`, planes (32 bits), ids (64 bits); then for each plane the number of zeros (64 bits),
    the ones before each 512 bits (32 bits each, padded to 8 bytes), and the bits in 64-bit words.
    """

    def __init__(self, body) -> None:
        magic, planes, self.n = _HEAD.unpack_from(body)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix")
        words = -(-self.n // 64)
        blocks = -(-words // _RANK_WORDS)
        at = _HEAD.size
        self.zeros, self.ranks, self.words = [], [], []
        for _ in range(planes):
            self.zeros.append(int(np.frombuffer(body, "<u8", 1, at)[0]))
            self.ranks.append(np.frombuffer(body, "<u4", blocks, at + 8))
            at += 8 + 8 * (-(-blocks // 2))
            self.words.append(np.frombuffer(body, "<u8", words, at))
            at += 8 * words

    def __len__(self) -> int:
        return self.n

    def _ones(self, plane: int, places: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        if not self.n:
            return np.zeros(len(places), np.int64)
        words, word = self.words[plane], places >> 6
        block = word // _RANK_WORDS
        last = len(self.ranks[plane]) - 1
        # The place after the last one may lie in a block of its own, which is not there.
        count = np.where(block <= last, self.ranks[plane][np.minimum(block, last)].astype(np.int64), self.n - self.zeros[plane])
        for step in range(_RANK_WORDS - 1):
            at = block * _RANK_WORDS + step
            inside = at < np.minimum(word, len(words))
            count += np.where(inside, np.bitwise_count(words[np.minimum(at, len(words) - 1)]), 0)
        low = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        own = np.where(word < len(words), words[np.minimum(word, len(words) - 1)] & low, np.uint64(0))
        return count + np.bitwise_count(own)

    def access(self, places: np.ndarray) -> np.ndarray:
        """The ids at some places."""
        places = np.asarray(places, np.int64)
        ids = np.zeros(len(places), np.uint32)
        for plane, words in enumerate(self.words):
            bit = (words[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)
            ones = self._ones(plane, places)
            places = np.where(bit == 1, self.zeros[plane] + ones, places - ones)
            ids = ids << np.uint32(1) | bit.astype(np.uint32)
        return ids

    def all(self) -> np.ndarray:
        """All ids in order: from the last plane up, zeros and ones go back to where they were."""
        kind = np.uint16 if len(self.words) <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for plane in range(len(self.words) - 1, -1, -1):
            one = np.unpackbits(self.words[plane].view(np.uint8), count=self.n, bitorder="little").view(bool)
            before = np.empty_like(ids)
            before[~one] = ids[: self.zeros[plane]]
            before[one] = ids[self.zeros[plane]:]
            ids = before | one.astype(kind) << kind(len(self.words) - 1 - plane)
        return ids.astype(np.uint32)

    def _range(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the occurrences of ids in [low, high) end up below the last plane."""
        for plane in range(len(self.words)):
            digit = (symbols >> (len(self.words) - 1 - plane)) & 1
            a, b = self._ones(plane, low), self._ones(plane, high)
            low = np.where(digit == 1, self.zeros[plane] + a, low - a)
            high = np.where(digit == 1, self.zeros[plane] + b, high - b)
        return low, high

    def count(self, symbols: np.ndarray, low: int = 0, high: int | None = None) -> np.ndarray:
        """How often each id occurs from place `low` to before `high`."""
        symbols = np.asarray(symbols, np.int64)
        known = (symbols >= 0) & (symbols >> len(self.words) == 0)
        ends = np.full(len(symbols), self.n if high is None else min(high, self.n), np.int64)
        a, b = self._range(np.where(known, symbols, 0), np.full(len(symbols), low, np.int64), ends)
        return np.where(known, np.maximum(b - a, 0), 0)

    def positions(self, symbol: int) -> np.ndarray:
        """All places of an id, in order: every occurrence is followed up from the last plane (select)."""
        if not int(self.count(np.array([symbol]))[0]):
            return np.zeros(0, np.int64)
        low, high = self._range(np.array([symbol], np.int64), np.zeros(1, np.int64), np.array([self.n], np.int64))
        places = np.arange(int(low[0]), int(high[0]), dtype=np.int64)
        for plane in range(len(self.words) - 1, -1, -1):
            digit = (symbol >> (len(self.words) - 1 - plane)) & 1
            places = self._select(plane, digit, places - self.zeros[plane] * digit)
        return places

    def _select(self, plane: int, digit: int, nth: np.ndarray) -> np.ndarray:
        """The place of the nth (from 0) bit of a kind: its block by binary search over counts, then its word, then its bit."""
        ranks = self.ranks[plane].astype(np.int64)
        if not digit:
            ranks = np.arange(len(ranks)) * _RANK_BITS - ranks
        words = self.words[plane] if digit else ~self.words[plane]
        block = np.searchsorted(ranks, nth, side="right") - 1
        left, word = nth - ranks[block], block * _RANK_WORDS
        for _ in range(_RANK_WORDS - 1):
            held = np.bitwise_count(words[np.minimum(word, len(words) - 1)]).astype(np.int64)
            go = left >= held
            left, word = np.where(go, left - held, left), np.where(go, word + 1, word)
        value = words[word]
        bit = np.zeros(len(nth), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            part = value >> bit.astype(np.uint64) & np.uint64((1 << step) - 1)
            held = np.bitwise_count(part).astype(np.int64)
            go = left >= held
            left, bit = np.where(go, left - held, left), np.where(go, bit + step, bit)
        return word * 64 + bit


def build(ids: np.ndarray) -> bytes:
    """The bytes of a matrix over some ids."""
    n = len(ids)
    planes = max(1, int(ids.max(initial=0)).bit_length())
    left = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    words = -(-n // 64)
    blocks = -(-words // _RANK_WORDS)
    out = [_HEAD.pack(_MAGIC, planes, n)]
    for digit in range(planes - 1, -1, -1):
        one = (left >> left.dtype.type(digit) & left.dtype.type(1)).astype(bool)
        bits = np.zeros(8 * words, np.uint8)
        packed = np.packbits(one, bitorder="little")
        bits[: len(packed)] = packed
        held = np.bitwise_count(bits.view("<u8")).astype(np.int64)
        sums = np.add.reduceat(held, np.arange(0, words, _RANK_WORDS)) if words else held
        ranks = np.zeros(2 * (-(-blocks // 2)), "<u4")
        ranks[:blocks] = np.cumsum(sums) - sums
        zero = left[~one]
        out += [struct.pack("<Q", len(zero)), ranks.tobytes(), bits.tobytes()]
        left = np.concatenate((zero, left[one]))
    return b"".join(out)


@dataclass(frozen=True)
class Index:
    """The shards with the place of their first id in the whole (`start`), and the type of the document ids."""

    shards: DataFrame
    key_type: T.DataType


def write(
    df: DataFrame,
    tokenizer: str,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    closing_id: int = CLOSING_ID,
    shard_tokens: int = SHARD_TOKENS,
    ranges: int | None = None,
) -> None:
    """Encode every text, add `closing_id`, and write all ids in ascending order of `key` below a new folder."""
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[key].dataType
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).select(
        "key", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row")
    )
    order = [F.asc_nulls_first("key"), F.asc("tie"), F.asc("row")]
    placed = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("key", "text")
    schema = T.StructType([
        T.StructField("part", T.LongType()), T.StructField("place", T.LongType()), T.StructField("before", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("keys", T.ArrayType(kind)),
        T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("matrix", T.BinaryType()),
    ])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding.encoder(tokenizer)
        part, place, before, keys, counts, ids, held = TaskContext.get().partitionId(), 0, 0, [], [], [], 0

        def shard() -> pa.RecordBatch:
            lengths = np.concatenate(counts)
            columns = [
                pa.array([part]), pa.array([place]), pa.array([before]), pa.array([held]),
                _as_list(pa.chunked_array(keys).combine_chunks()), _as_list(pa.array(lengths)),
                pa.array([build(np.concatenate(ids))], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            for piece in _by_size(batch):
                own, sizes = encode.encode(piece.column(1))
                own, sizes = with_closing(own, sizes, closing_id)
                keys, counts, ids, held = [*keys, piece.column(0)], [*counts, sizes], [*ids, own], held + len(own)
                if held >= shard_tokens:
                    yield shard()
                    place, before = place + 1, before + held
                    keys, counts, ids, held = [], [], [], 0
        if held:
            yield shard()

    placed.mapInArrow(task, schema).write.parquet(f"{path}/shards")
    # One row per range: their number is a parameter.
    totals = spark.read.schema(schema).parquet(f"{path}/shards").groupBy("part").agg(F.sum("n_tokens")).collect()
    starts, run = [], 0
    for part, total in sorted(tuple(r) for r in totals):
        starts.append((part, run))
        run += total
    spark.createDataFrame(starts, "part long, part_start long").coalesce(1).write.parquet(f"{path}/ranges")


def open_index(spark: SparkSession, path: str) -> Index:
    shards = spark.read.parquet(f"{path}/shards")
    ranges = spark.read.schema("part long, part_start long").parquet(f"{path}/ranges")
    # As many rows as there are ranges.
    placed = shards.join(F.broadcast(ranges), "part").withColumn("start", F.col("part_start") + F.col("before"))
    return Index(placed.drop("part_start", "before"), shards.schema["keys"].dataType.elementType)


def documents(index: Index) -> DataFrame:
    """Every document from the files: `key`, `start` (ids before it), `n_tokens` and `ids` (little-endian, 32 bits)."""
    schema = T.StructType([
        T.StructField("key", index.key_type), T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])

    def unpacked(start: int, keys: pa.Array, lengths: np.ndarray, matrix: Matrix) -> pa.RecordBatch:
        ends = np.cumsum(lengths)
        places = pa.array(4 * np.concatenate(([0], ends)), pa.int64()).buffers()[1]
        ids = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(lengths), [None, places, pa.py_buffer(matrix.all().astype("<u4"))]
        )
        columns = [keys, pa.array(start + ends - lengths), pa.array(lengths), ids.cast(pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return _per_shard(index.shards, unpacked, schema)


def counts(index: Index, symbols: Sequence[int]) -> DataFrame:
    """`token` and `n`, its occurrences in all documents, for each of some ids; nothing is unpacked."""
    wanted = np.unique(np.array(symbols, np.int64))

    def counted(start: int, keys: pa.Array, lengths: np.ndarray, matrix: Matrix) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(wanted), pa.array(matrix.count(wanted))], names=["token", "n"])

    found = _per_shard(index.shards, counted, "token long, n long")
    every = index.shards.sparkSession.createDataFrame([(int(s), 0) for s in wanted], "token long, n long")
    return found.unionByName(every).groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(index: Index, symbols: Sequence[int]) -> DataFrame:
    """`token`, `position` in the whole, `key` and `offset` in the document for every occurrence of some ids."""
    wanted = np.unique(np.array(symbols, np.int64))
    schema = T.StructType([
        T.StructField("token", T.LongType()), T.StructField("position", T.LongType()),
        T.StructField("key", index.key_type), T.StructField("offset", T.LongType()),
    ])

    def looked_up(start: int, keys: pa.Array, lengths: np.ndarray, matrix: Matrix) -> pa.RecordBatch:
        places = [matrix.positions(int(s)) for s in wanted]
        tokens = np.repeat(wanted, [len(p) for p in places])
        at = np.concatenate([*places, np.zeros(0, np.int64)])
        ends = np.cumsum(lengths)
        owner = np.searchsorted(ends, at, side="right")
        columns = [pa.array(tokens), pa.array(start + at), keys.take(pa.array(owner)), pa.array(at - (ends - lengths)[owner])]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    return _per_shard(index.shards, looked_up, schema)


def tokens_at(index: Index, positions: DataFrame, column: str = "position") -> DataFrame:
    """`position` and `token` for every distinct position of a table that lies inside the whole.

    A shard covers a few steps of `SHARD_TOKENS` positions; those steps join it with the positions asked for. A group
    holds one shard and as many positions as it has ids at most.
    """
    step = SHARD_TOKENS
    spans = index.shards.select(
        F.col("start").alias("shard"), "n_tokens",
        F.explode(F.sequence(F.expr(f"start DIV {step}"), F.expr(f"(start + n_tokens - 1) DIV {step}"))).alias("step"),
    )
    asked = positions.select(F.col(f"`{column}`").cast("long").alias("position")).where("position >= 0").distinct()
    inside = (F.col("position") >= F.col("shard")) & (F.col("position") < F.col("shard") + F.col("n_tokens"))
    placed = asked.withColumn("step", F.expr(f"position DIV {step}")).join(spans, "step").where(inside).select("shard", "position")

    def look(shard: pa.Table, places: pa.Table) -> pa.Table:
        if not (len(shard) and len(places)):
            return pa.table({"position": pa.array([], pa.int64()), "token": pa.array([], pa.int64())})
        at = places.column("position").to_numpy()
        found = Matrix(shard.column("matrix")[0].as_buffer()).access(at - shard.column("start")[0].as_py())
        return pa.table({"position": pa.array(at), "token": pa.array(found.astype(np.int64))})

    left = index.shards.select("start", "matrix").groupBy("start")
    return left.cogroup(placed.groupBy("shard")).applyInArrow(look, "position long, token long")


def _per_shard(shards: DataFrame, made: Callable[..., pa.RecordBatch], schema) -> DataFrame:
    """Rows made from one shard at a time: its start, its keys and lengths, and its matrix."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, keys, lengths, bodies = batch.columns
            for i in range(batch.num_rows):
                own = lengths[i].values.to_numpy(zero_copy_only=False)
                yield made(start[i].as_py(), keys[i].values, own, Matrix(bodies[i].as_buffer()))

    return shards.select("start", "keys", "lengths", "matrix").mapInArrow(task, schema)


def _as_list(values: pa.Array) -> pa.ListArray:
    """One list of all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _by_size(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about `limit` bytes, or one row."""
    for first, texts in textarrays.chunks(batch.column(1), limit):
        yield batch.slice(first, len(texts))
