"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted arrays on shared disk.

Tokens of a text are its words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased) and one end.

1. Words: every task counts its words' 64-bit hashes; counts meet by hash range and become sorted
   arrays. A word's number is its place in all of them together.
2. Pairs: tasks map the word arrays into memory, number their tokens and count pairs of neighbours
   (a text begins after a start mark). Sorted runs of pairs meet by pair hash, so a frequent word,
   line or pair is spread like any other, and become sorted arrays of pairs with counts.
3. Words again: per word how many distinct words it follows, and how many distinct words follow it
   once, twice and more often, summed from the pairs of each shard first.
4. Scores: tasks map all arrays into memory; a token's probability is its pair's discounted share plus
   the freed weight times the word's continuation share, which in turn is discounted and mixed with an
   even share for every word and one unknown word. Probabilities after any context sum to one.

Memory per task is bounded by a batch of texts, or by a shard, whose number follows the input's size.
Arrays are files in the shared folder, which workers must have mounted (a `file:` path); mapped pages
can be evicted. A file is written under a name of its own and then renamed, so repeated attempts do no
harm. Texts with null count as empty: one end. Repeated rows count as often as they come. Without
training rows every probability is 1. Only the key columns and the results are returned.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsafe.errors import InferenceError, SchemaError
from foldsafe.llm import textarrays
from foldsafe.llm.textarrays import LOWER_TABLE, Texts, mix
from foldsafe.sources import scratch

SMOOTHING = 0.1
WORD_SHARD_BYTES = 64 << 20
PAIR_SHARD_BYTES = 32 << 20
STATS_PER_SHARD = 1 << 20
_HELD = 3_000_000
_CHUNK = 2 << 20
END = np.uint64(0x5EED5EED5EED5EED)  # hash of the end token
_MOST_WORDS = 1 << 32
_BIG = 255


def _folder(df: DataFrame) -> str:
    path = scratch.new_path(df.sparkSession, "ngram-model")
    scheme, _, rest = path.partition(":")
    if path.startswith("/"):
        # Spark would resolve it by its default file system.
        default = df.sparkSession.sparkContext.getConf().get("spark.hadoop.fs.defaultFS", "file:///")
        scheme, rest = default.partition(":")[0], path
    if scheme != "file":
        raise SchemaError("the model's arrays need a shared folder that workers have mounted (a file: path)")
    return "/" + rest.lstrip("/")


def _save(folder: str, name: str, values: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    own = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(own, "wb") as file:
        file.write(memoryview(np.ascontiguousarray(values)).cast("B") if len(values) else b"")
    os.replace(own, f"{folder}/{name}")


def _mapped(folder: str, name: str, kind: type, length: int) -> np.ndarray:
    """An array of the given length; one that is not there, or not whole, is an error, never a score."""
    path = f"{folder}/{name}"
    if not length:
        return np.zeros(0, kind)
    held = os.path.getsize(path) if os.path.exists(path) else -1
    if held != length * np.dtype(kind).itemsize:
        raise InferenceError(f"{path} should hold {length} numbers and has {max(held, 0)} bytes: is the folder mounted here?")
    return np.memmap(path, kind, "r")


@dataclass(frozen=True)
class Model:
    folder: str
    word_counts: list[int]  # words per word shard
    tokens: int
    texts: int
    pair_sizes: list[tuple[int, int]] = field(default_factory=list)  # pairs, and those counted in full, per pair shard
    stats_width: int = STATS_PER_SHARD  # words per file of word statistics
    pair_discounts: list[float] = field(default_factory=list)
    word_discounts: list[float] = field(default_factory=list)
    distinct_pairs: int = 0
    word_free: float = 1.0  # weight of the even share

    @property
    def words(self) -> int:
        return sum(self.word_counts)


def discounts(n: Sequence[int]) -> list[float]:
    """What is taken off counts 1, 2 and above, from how many items have the counts 1, 2, 3, 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return [0.0, 0.5, 0.75, 0.75]
    share = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * share * n2 / n1, 2 - 3 * share * n3 / n2, 3 - 4 * share * n4 / n3 if n3 else 1.5]
    return [0.0] + [min(max(d, 0.0), i + 1 - 1e-3) for i, d in enumerate(raw)]


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards by hash range, in order."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _block(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Keys, counts in a byte each, and in full those that do not fit."""
    small = np.minimum(counts, _BIG).astype(np.uint8)
    big = counts[counts >= _BIG].astype("<i8")
    return np.int64(len(keys)).tobytes() + keys.astype("<u8").tobytes() + small.tobytes() + big.tobytes()


def _unblock(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    keys = np.frombuffer(data, "<u8", n, 8)
    counts = np.frombuffer(data, np.uint8, n, 8 + 8 * n).astype(np.int64)
    counts[counts == _BIG] = np.frombuffer(data, "<i8", offset=8 + 9 * n)
    return keys, counts


def _merged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    parts = [_unblock(b.as_buffer()) for chunk in column.chunks for b in chunk]
    return _summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the tokens, an end after each row's words."""
    starts, rows = texts.words()
    hashes = texts.hashes(starts, LOWER_TABLE)
    counts = np.bincount(rows, minlength=len(texts)) + 1
    out = np.full(int(counts.sum()), END)
    word = np.ones(len(out), bool)
    word[np.cumsum(counts) - 1] = False
    out[word] = hashes
    return out, np.repeat(np.arange(len(texts)), counts)


class Counter:
    """Counts keys and hands out blocks per shard whenever it holds many."""

    def __init__(self, shards: int, shard_of: Callable[[np.ndarray], np.ndarray]):
        self._shards, self._shard_of = shards, shard_of
        self._keys: list[np.ndarray] = []
        self._held = 0

    def add(self, keys: np.ndarray) -> Iterator[tuple[int, bytes]]:
        self._keys.append(keys)
        self._held += len(keys)
        if self._held > _HELD:
            yield from self.flush()

    def flush(self) -> Iterator[tuple[int, bytes]]:
        if not self._held:
            return
        keys = np.concatenate(self._keys)
        self._keys, self._held = [], 0
        keys.sort()
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        counts = np.diff(np.append(heads, len(keys)))
        keys = keys[heads]
        shards = self._shard_of(keys)
        order = np.argsort(shards, kind="stable")
        edges = np.searchsorted(shards[order], np.arange(self._shards + 1))
        for s in np.flatnonzero(np.diff(edges)).tolist():
            own = order[edges[s]: edges[s + 1]]
            yield s, _block(keys[own], counts[own])


_BLOCKS = "shard long, block binary"


def _blocks(pairs: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for shard, block in pairs:
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([block], pa.binary())], names=["shard", "block"])


def _count_blocks(df: DataFrame, shards: int, make: Callable, shard_of: Callable) -> DataFrame:
    """Blocks of counted keys; `make` gives the function from texts to keys, once per task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, keys_of = Counter(shards, shard_of), make()
        for batch in batches:
            for _, texts in textarrays.chunks(batch.column(0), _CHUNK):
                yield from _blocks(counter.add(keys_of(texts)))
        yield from _blocks(counter.flush())

    return df.mapInArrow(task, _BLOCKS)


def learn(df: DataFrame, text: str = "text") -> Model:
    rows = df.select(F.col(f"`{text}`").alias("text"))
    folder = _folder(df)
    texts, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    word_shards = -(-(size + 1) // WORD_SHARD_BYTES)
    blocks = _count_blocks(rows, word_shards, lambda: lambda t: tokens(t)[0], lambda k: _shard_of(k, word_shards))
    found = blocks.groupBy("shard").applyInArrow(_word_task(folder), "shard long, words long, tokens long").collect()
    per_shard = {r["shard"]: r["words"] for r in found}
    model = Model(
        folder, [per_shard.get(s, 0) for s in range(word_shards)], sum(r["tokens"] for r in found), texts,
        stats_width=STATS_PER_SHARD,
    )
    if model.words >= _MOST_WORDS:
        raise SchemaError("more distinct words than 32-bit numbers")
    return _learn_pairs(rows, model, -(-(size + 1) // PAIR_SHARD_BYTES)) if model.words else model


def _word_task(folder: str):
    def task(key, table):
        shard = key[0].as_py()
        keys, counts = _merged(table.column("block"))
        _save(folder, f"words-{shard}", keys)
        _save(folder, f"counts-{shard}", counts.astype("<i8"))
        return pa.table({"shard": [shard], "words": [len(keys)], "tokens": [int(counts.sum())]})

    return task


class Words:
    """The word arrays, mapped into memory."""

    def __init__(self, model: Model):
        shards = range(len(model.word_counts))
        self.keys = [_mapped(model.folder, f"words-{s}", "<u8", model.word_counts[s]) for s in shards]
        self.counts = [_mapped(model.folder, f"counts-{s}", "<i8", model.word_counts[s]) for s in shards]
        self.first = np.concatenate(([0], np.cumsum(model.word_counts)))
        self.start = model.words  # number of the start mark, and of no word

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word (-1: unknown); hashes must be sorted."""
        out = np.full(len(hashes), -1, np.int64)
        edges = np.searchsorted(_shard_of(hashes, len(self.keys)), np.arange(len(self.keys) + 1))
        for s, keys in enumerate(self.keys):
            own = hashes[edges[s]: edges[s + 1]]
            if len(own) and len(keys):
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                out[edges[s]: edges[s + 1]] = np.where(keys[at] == own, self.first[s] + at, -1)
        return out

    def gather(self, arrays: list[np.ndarray], numbers: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Values of sorted numbers from arrays that hold consecutive ranges; 0 outside."""
        out = np.zeros(len(numbers), np.int64)
        cut = np.searchsorted(numbers, edges)
        for s, values in enumerate(arrays):
            own = numbers[cut[s]: cut[s + 1]]
            if len(own):
                out[cut[s]: cut[s + 1]] = values[own - edges[s]]
        return out


def _pair_shard(shards: int) -> Callable[[np.ndarray], np.ndarray]:
    return lambda keys: _shard_of(mix(keys), shards)


def _before(numbers: np.ndarray, rows: np.ndarray, start: int) -> np.ndarray:
    """The number before each token: the start mark at the head of a row."""
    out = np.full(len(numbers), start, np.int64)
    out[1:] = numbers[:-1]
    heads = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
    out[heads] = start
    return out


def _pairs_of(model: Model):
    words = Words(model)

    def keys(texts: Texts) -> np.ndarray:
        hashes, rows = tokens(texts)
        distinct, place = np.unique(hashes, return_inverse=True)
        numbers = words.numbers(distinct)[place]
        first = _before(numbers, rows, words.start)
        return first.astype(np.uint64) << np.uint64(32) | numbers.astype(np.uint64)

    return keys


def _learn_pairs(rows: DataFrame, model: Model, shards: int) -> Model:
    blocks = _count_blocks(rows, shards, lambda: _pairs_of(model), _pair_shard(shards))
    parts = blocks.groupBy("shard").applyInArrow(_pair_task(model), "range long, sums binary")
    found = parts.groupBy("range").applyInArrow(_stats_task(model), "range long, sums binary").collect()
    sums = np.zeros(5, np.int64)
    pairs = np.zeros(5, np.int64)
    sizes = [(0, 0)] * shards
    for row in found:
        values = np.frombuffer(row["sums"], "<i8")
        if row["range"] < -1:
            sizes[-2 - row["range"]] = (int(values[0]), int(values[1]))
        elif row["range"] < 0:
            pairs += values
        else:
            sums += values
    by_word = discounts(sums[:4])
    taken = by_word[1] * sums[0] + by_word[2] * sums[1] + by_word[3] * (sums[4] - sums[0] - sums[1])
    return replace(
        model, pair_sizes=sizes, pair_discounts=discounts(pairs[:4]), word_discounts=by_word,
        distinct_pairs=int(pairs[4]), word_free=float(taken) / float(pairs[4]),
    )


def _count_of_counts(counts: np.ndarray) -> np.ndarray:
    """How many are 1, 2, 3, 4, and how many there are."""
    return np.array([np.count_nonzero(counts == i) for i in (1, 2, 3, 4)] + [np.count_nonzero(counts)], "<i8")


def _pair_task(model: Model):
    """Write a shard's pairs; hand on what each word gets from them, by ranges of words."""

    def task(key, table):
        shard = key[0].as_py()
        keys, counts = _merged(table.column("block"))
        big = counts >= _BIG
        _save(model.folder, f"pairs-{shard}", keys)
        _save(model.folder, f"small-{shard}", np.minimum(counts, _BIG).astype(np.uint8))
        _save(model.folder, f"bigkeys-{shard}", keys[big])
        _save(model.folder, f"big-{shard}", counts[big].astype("<i8"))
        first = (keys >> np.uint64(32)).astype(np.int64)
        second = np.sort(keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        heads = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
        kinds = np.minimum(counts, 3)
        after = np.stack([np.add.reduceat((kinds == i).astype(np.int64), heads) for i in (1, 2, 3)])
        begin = np.flatnonzero(np.append(True, second[1:] != second[:-1]))
        follows = np.diff(np.append(begin, len(second)))
        words = np.concatenate((first[heads], second[begin]))
        values = np.zeros((4, len(words)), np.uint32)
        values[1:, : len(heads)] = after
        values[0, len(heads):] = follows
        order = np.argsort(words, kind="stable")
        words, values = words[order], values[:, order]
        cut = np.searchsorted(words, np.arange(0, model.words + 1 + model.stats_width, model.stats_width))
        # Negative ranges: counts of counts of all shards, and how long this shard's arrays are.
        sizes = np.array([len(keys), np.count_nonzero(big), 0, 0, 0], "<i8")
        out = {"range": [-1, -2 - shard], "sums": [_count_of_counts(counts).tobytes(), sizes.tobytes()]}
        for r in np.flatnonzero(np.diff(cut)).tolist():
            own = slice(cut[r], cut[r + 1])
            out["range"].append(r)
            out["sums"].append(_pack_stats(words[own] - r * model.stats_width, values[:, own]))
        return pa.table([pa.array(out["range"], pa.int64()), pa.array(out["sums"], pa.binary())], names=["range", "sums"])

    return task


def _pack_stats(words: np.ndarray, values: np.ndarray) -> bytes:
    """Places in the range and four counts each, counts in the fewest bytes that hold them all."""
    out = [np.int64(len(words)).tobytes(), words.astype("<u4").tobytes()]
    for v in values:
        small = np.minimum(v, _BIG).astype(np.uint8)
        out += [small.tobytes(), v[v >= _BIG].astype("<u4").tobytes()]
    return b"".join(out)


def _unpack_stats(data: pa.Buffer) -> tuple[np.ndarray, list[np.ndarray]]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    words, at, values = np.frombuffer(data, "<u4", n, 8), 8 + 4 * n, []
    for _ in range(4):
        v = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
        at += n
        big = np.flatnonzero(v == _BIG)
        v[big] = np.frombuffer(data, "<u4", len(big), at)
        at += 4 * len(big)
        values.append(v)
    return words, values


STATS = ("follows", "once", "twice", "often")


def _stats_task(model: Model):
    """Add up what a range of words got from all shards, and write it."""

    def task(key, table):
        number = key[0].as_py()
        blobs = [b.as_buffer() for chunk in table.column("sums").chunks for b in chunk]
        if number < 0:
            total = np.sum([np.frombuffer(b, "<i8") for b in blobs], axis=0)
        else:
            width = min(model.stats_width, model.words + 1 - number * model.stats_width)
            sums = np.zeros((4, width), np.int64)
            for b in blobs:
                words, values = _unpack_stats(b)
                for i, v in enumerate(values):
                    np.add.at(sums[i], words, v)  # a word comes once as first and once as second
            total = _count_of_counts(sums[0])
            for name, v in zip(STATS, sums):
                _save(model.folder, f"{name}-{number}", v.astype("<u4"))
        return pa.table([pa.array([number], pa.int64()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["range", "sums"])

    return task


class Scorer:
    """All arrays of a model, mapped into memory."""

    def __init__(self, model: Model):
        self.model, self.words = model, Words(model)
        ranges = range(-(-(model.words + 1) // model.stats_width) if model.words else 0)
        self.edges = np.minimum(np.arange(len(ranges) + 1) * model.stats_width, model.words + 1)
        widths = np.diff(self.edges).tolist()
        self.stats = {n: [_mapped(model.folder, f"{n}-{r}", "<u4", widths[r]) for r in ranges] for n in STATS}
        names = ("pairs", "small", "bigkeys", "big")
        kinds = ("<u8", np.uint8, "<u8", "<i8")
        self.shards = [
            [_mapped(model.folder, f"{n}-{s}", k, size) for n, k, size in zip(names, kinds, (n_pairs, n_pairs, n_big, n_big))]
            for s, (n_pairs, n_big) in enumerate(model.pair_sizes)
        ]

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        shards = _pair_shard(len(self.shards))(keys)
        order = np.argsort(shards, kind="stable")  # keys are sorted, so each shard's stay sorted
        edges = np.searchsorted(shards[order], np.arange(len(self.shards) + 1))
        for s, (pairs, small, big_keys, big) in enumerate(self.shards):
            own = order[edges[s]: edges[s + 1]]
            if not len(own) or not len(pairs):
                continue
            asked = keys[own]
            at = np.minimum(np.searchsorted(pairs, asked), len(pairs) - 1)
            counts = np.where(pairs[at] == asked, small[at], 0).astype(np.int64)
            large = np.flatnonzero(counts == _BIG)
            if len(large):
                counts[large] = big[np.searchsorted(big_keys, asked[large])]
            out[own] = counts
        return out

    def score(self, texts: Texts) -> dict[str, np.ndarray]:
        model, n = self.model, len(texts)
        hashes, rows = tokens(texts)
        totals = np.bincount(rows, minlength=n)
        out = {"n_tokens": totals, "n_known": np.zeros(n, np.int64), "base_score": np.zeros(n), "score": np.zeros(n)}
        even = SMOOTHING * (model.words + 1)
        distinct, place = np.unique(hashes, return_inverse=True)
        numbers = self.words.numbers(distinct)
        by_number = np.argsort(numbers, kind="stable")
        asked = numbers[by_number]

        def values(arrays: list[np.ndarray], edges: np.ndarray) -> np.ndarray:
            found = np.zeros(len(distinct), np.int64)
            found[by_number] = self.words.gather(arrays, asked, edges)
            return found

        count = values(self.words.counts, self.words.first)
        out["n_known"] = np.bincount(rows[(count > 0)[place]], minlength=n)
        base = np.log10((count + SMOOTHING) / (model.tokens + even))
        out["base_score"] = np.bincount(rows, base[place], minlength=n)
        if not model.words:
            return out
        stats = {name: values(arrays, self.edges) for name, arrays in self.stats.items()}
        cut = np.array(model.word_discounts)
        lower = np.maximum(stats["follows"] - cut[np.minimum(stats["follows"], 3)], 0) / model.distinct_pairs
        lower += model.word_free / (model.words + 1)
        pair_cut = np.array(model.pair_discounts)
        freed = sum(pair_cut[i + 1] * stats[name] for i, name in enumerate(STATS[1:]))
        free = np.where(count > 0, freed / np.maximum(count, 1), 1.0)
        start = np.array([self.words.start])
        start_stats = [self.words.gather(self.stats[name], start, self.edges)[0] for name in STATS[1:]]
        start_free = sum(pair_cut[i + 1] * v for i, v in enumerate(start_stats)) / model.texts
        # Index of the token before: a place among the distinct tokens, or -1 for the start.
        heads = np.append(True, rows[1:] != rows[:-1])
        previous = np.append(-1, place[:-1])
        previous[heads] = -1
        context = np.where(previous < 0, self.words.start, numbers[previous])
        total = np.where(previous < 0, model.texts, count[previous])
        weight = np.where(previous < 0, start_free, free[previous])
        own = numbers[place]
        known = (context >= 0) & (own >= 0)
        keys = context[known].astype(np.uint64) << np.uint64(32) | own[known].astype(np.uint64)
        asked_keys, where = np.unique(keys, return_inverse=True)
        pair = np.zeros(len(rows), np.int64)
        pair[known] = self.pair_counts(asked_keys)[where]
        share = np.maximum(pair - pair_cut[np.minimum(pair, 3)], 0) / np.maximum(total, 1)
        out["score"] = np.bincount(rows, np.log10(share + weight * lower[place]), minlength=n)
        return out


_RESULT = (
    ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()),
)


def score(df: DataFrame, model: Model, keys: Sequence[Column], text: str = "text") -> DataFrame:
    """The key columns of every row with `n_tokens`, `n_known`, `base_score`, `score` and `train_tokens`."""
    picked = df.select(*keys, F.col(f"`{text}`").alias("_scored_text"))
    fields = picked.schema.fields[:-1]
    schema = T.StructType(fields + [T.StructField(n, k) for n, k in _RESULT])
    order = schema.names
    order_kinds = {n: pa.int64() if isinstance(k, T.LongType) else pa.float64() for n, k in _RESULT}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            parts = [scorer.score(t) for _, t in textarrays.chunks(batch.column(len(fields)), _CHUNK)]
            made = [pa.array(np.concatenate([p[n] for p in parts])) if parts else pa.array([], order_kinds[n]) for n, _ in _RESULT]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(fields))] + made, names=order)

    return picked.mapInArrow(task, schema).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
