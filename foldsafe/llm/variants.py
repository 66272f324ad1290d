"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

A word's letters, each numbered by its occurrence (`l1`, `l2`), are the ones of a binary vector. One
inserted or deleted letter changes one place of it, one replaced letter two (or none, where the vector
does not see the order). So two words one edit apart have vectors at a Hamming distance of at most 2 if they are
equally long, and of exactly 1 if they are not. The places are dealt over `k + m` parts; two vectors at a
distance of at most k differ in at most k parts, so they agree in all places of some m parts. Every choice of
m parts gives a signature: the hash of the word's places in them, with the length and the choice. Words
that share one are joined on it and the pair is verified by its edit distance. No pair is lost; a clash
of hashes only adds a candidate.

Equally long words meet in signatures of `EQUAL` parts less two, others in those of `UNEQUAL` parts less
one, where a word stands once as the longer and once as the shorter of a pair.

Words are distinct and not null; null words are left out. An empty table gives an empty result. Order of
words is by code point. Only the named columns are read, so others cannot clash. Memory of a task is
bounded by a chunk of words or one long word; nothing is collected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsafe.llm import textarrays
from foldsafe.llm.textarrays import combine, mix
from foldsafe.sources import scratch

EQUAL = 7
UNEQUAL = 5
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_KEPT_BYTES = 1 << 26
_BOTH, _SHORTER, _LONGER = 0, 1, 2
_CHUNK = 1 << 18
# The most frequent places are dealt over the parts evenly, others by hash; which way decides nothing but speed.
_PLACES = 1000
# The table of the usual byte-wise crc32, from the library's checksums of single bytes.
_CRC = np.array([zlib.crc32(bytes([i ^ 0xFF])) ^ 0xFF000000 for i in range(256)], np.uint32)
_SIGNED = "sig long, side byte, word string, n long"


def word_counts(
    df: DataFrame, text: str = "text", least_length: int = 1, key: str | None = None, every: int | None = None
) -> DataFrame:
    """`word` and `n`: how often each run of letters occurs, with A-Z lower-cased, if it has `least_length` code points.

    With `every`, a run first loses one code point if `every` divides h, the unsigned crc32 of `<key>:<run>` (a null key
    is empty): the one at h modulo its length, counted from 0. A task counts its own words, up to `_KEPT_BYTES` of
    them at a time; only those sums are shuffled.
    """
    own = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")) if key else F.lit("")
    picked = df.select(own.alias("key"), F.col(f"`{text}`").alias("text"))
    return picked.mapInArrow(_counter(least_length, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Seen:
    """Words and their counts, looked up by hash; the bytes of each word are kept once."""

    def __init__(self) -> None:
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.body = bytearray()

    def add(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        hashes, one, counts = np.unique(hashes, return_index=True, return_counts=True)
        if len(self.hashes):
            slots = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[slots] == hashes
            self.counts[slots[known]] += counts[known]
            hashes, one, counts = hashes[~known], one[~known], counts[~known]
        if not len(hashes):
            return
        starts, sizes = starts[one], sizes[one]
        first = np.cumsum(sizes) - sizes
        self.first = np.concatenate((self.first, len(self.body) + first))
        self.body += data[np.arange(sizes.sum()) + np.repeat(starts - first, sizes)].tobytes()
        merged = np.concatenate((self.hashes, hashes))
        order = np.argsort(merged, kind="stable")
        self.hashes, self.first = merged[order], self.first[order]
        self.counts = np.concatenate((self.counts, counts))[order]
        self.sizes = np.concatenate((self.sizes, sizes))[order]

    def full(self) -> bool:
        return len(self.body) + 32 * len(self.hashes) > _KEPT_BYTES

    def batch(self) -> pa.RecordBatch:
        body = bytes(self.body)
        words = [body[f: f + n] for f, n in zip(self.first.tolist(), self.sizes.tolist())]
        return _batch(words, self.counts)


def _batch(words: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts)], names=["word", "n"])


def _counter(least: int, every: int | None):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            for first, texts in textarrays.chunks(batch.column(1)):
                changed = _count(seen, texts, batch.column(0), first, least, every)
                if changed:
                    yield _batch(changed, np.ones(len(changed), np.int64))
                if seen.full():
                    yield seen.batch()
                    seen = _Seen()
        yield seen.batch()

    return task


def _count(seen: _Seen, texts: textarrays.Texts, keys: pa.Array, first: int, least: int, every: int | None) -> list[bytes]:
    """Count the words of some texts; those that lost a letter are returned instead."""
    data = texts.data
    if not len(data):
        return []
    letter = _LETTER[data]
    # U+00C0 to U+00FF are the two-byte characters that begin with C3.
    letter[1:] |= data[:-1] == 0xC3
    blanked = textarrays.Texts(np.where(letter, _LOWERED[data], np.uint8(0x20)), texts.offsets)
    starts, rows = blanked.words()
    if not len(starts):
        return []
    size = np.add.reduceat(letter, starts, dtype=np.int32)
    points = np.add.reduceat(letter & texts.characters(), starts, dtype=np.int32)
    long = points >= least
    hashes = blanked.hashes(starts, textarrays.WORD_TABLE)[long]
    starts, rows, size = starts[long], rows[long], size[long].astype(np.int64)
    changed = []
    if every and len(starts):
        own, where = np.unique(rows, return_inverse=True)
        heads = np.array([zlib.crc32(f"{keys[first + r].as_py()}:".encode()) for r in own.tolist()], np.uint32)
        marks = _crc32(blanked.data, starts, size, heads[where])
        cut = marks % np.uint32(every) == 0
        for s, n, mark in zip(starts[cut].tolist(), size[cut].tolist(), marks[cut].tolist()):
            word = blanked.data[s: s + n].tobytes().decode()
            place = mark % len(word)
            if len(word) > least:
                changed.append((word[:place] + word[place + 1:]).encode())
        starts, size, hashes = starts[~cut], size[~cut], hashes[~cut]
    if len(starts):
        seen.add(blanked.data, hashes, starts, size)
    return changed


def _crc32(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The crc32 of every span, carried on from the crc32 of what comes before it: one step per byte for all spans."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    state = before[order] ^ np.uint32(0xFFFFFFFF)
    for step in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -step, side="left"))
        state[:n] = _CRC[(state[:n] ^ data[starts[:n] + step]) & np.uint32(0xFF)] ^ (state[:n] >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def near(words: DataFrame, equal: int = EQUAL, unequal: int = UNEQUAL) -> DataFrame:
    """Each pair of words one edit apart once: `a`, `a_n`, `b`, `b_n` of a table of distinct `word` and `n`.

    More parts (at least 3 and 2) mean more signatures and fewer candidates that fail; the pairs are the same.
    """
    if equal < 3 or unequal < 2:
        raise ValueError("at least 3 and 2 parts are needed")
    plain = words.select("word", F.col("n").cast("long").alias("n")).where("word IS NOT NULL")
    shares = _shares(plain)
    task = _signer(_dealt(shares, equal), _dealt(shares, unequal))
    signed = scratch.written(plain.mapInArrow(task, _SIGNED), "variant-signatures")
    left = signed.where(F.col("side") != _LONGER).select("sig", "side", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = signed.where(F.col("side") != _SHORTER).select("sig", F.col("word").alias("b"), F.col("n").alias("b_n"))
    once = (F.col("side") == _SHORTER) | (F.col("a") < F.col("b"))
    verified = F.levenshtein("a", "b", 1) == 1
    return left.join(right, "sig").where(once & verified).select("a", "a_n", "b", "b_n").distinct()


def group(words: DataFrame, factor: int = 2) -> DataFrame:
    """`word`, `form`, `root`, `n`, `n_near`, `form_n` for every distinct `word` with its count `n`.

    `n_near` is the number of words one edit apart. `form` is the most frequent of them (ties: the smallest)
    if it is at least `factor` times (2 or more) as frequent as the word, else null. `root` is what following forms ends
    at, the word itself if it has none: counts grow along the way, so it does end.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more")
    words = scratch.written(words.select("word", F.col("n").cast("long").alias("n")).where("word IS NOT NULL"), "variant-words")
    pairs = scratch.written(near(words), "variant-pairs")
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    )
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near")))
    judged = (
        pairs.select(F.inline(sides))
        .groupBy("word", "n")
        .agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
        .select("word", "n_near", F.when(-F.col("best.rank") >= factor * F.col("n"), F.col("best")).alias("best"))
        .select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.rank")).alias("form_n"))
    )
    judged = scratch.written(judged, "variant-forms")
    ends = _ends(judged.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return (
        words.join(judged, "word", "left")
        .join(ends, "word", "left")
        .select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n",
        )
    )


def _ends(links: DataFrame) -> DataFrame:
    """Follow links to their ends; each round doubles the steps taken, and counts double along a link, so
    rounds grow with the logarithm of the logarithm of the largest count."""
    links = scratch.written(links, "variant-links")
    while True:
        after = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = links.join(after, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        moved = scratch.written(moved, "variant-links")
        links = moved.select("word", "root")
        if not moved.agg(F.coalesce(F.max("moved"), F.lit(False))).first()[0]:
            return links


class _Parts:
    """Which part each place of a vector belongs to."""

    def __init__(self, count: int, places: np.ndarray, parts: np.ndarray):
        self.count, self._places, self._parts = count, places, parts

    def of(self, places: np.ndarray) -> np.ndarray:
        part = (mix(places + np.uint64(self.count)) % np.uint64(self.count)).astype(np.int64)
        if len(self._places):
            slot = np.minimum(np.searchsorted(self._places, places), len(self._places) - 1)
            part = np.where(self._places[slot] == places, self._parts[slot], part)
        return part


def _shares(words: DataFrame) -> list[tuple[int, float]]:
    """The most frequent places and the share of words that have each: at most `_PLACES` rows are collected."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in textarrays.chunks(batch.column(0), _CHUNK):
                places, counts = np.unique(_places(texts)[1], return_counts=True)
                arrays = [pa.array(places.view(np.int64)), pa.array(counts.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=["place", "n"])

    counted = words.select("word").mapInArrow(task, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    found = counted.orderBy(F.desc("n"), "place").limit(_PLACES).collect()
    total = max(1, words.count())
    return [(r["place"], r["n"] / total) for r in found]


def _dealt(shares: list[tuple[int, float]], count: int) -> _Parts:
    """Parts that tell words apart about equally well: places by falling p(1-p), each to the part with the least."""
    load, parts = [0.0] * count, {}
    for place, share in sorted(shares, key=lambda x: (-x[1] * (1 - x[1]), x[0])):
        part = load.index(min(load))
        load[part] += share * (1 - share)
        parts[place] = part
    places = np.array(list(parts), np.int64).view(np.uint64)
    order = np.argsort(places)
    return _Parts(count, places[order], np.array(list(parts.values()), np.int64)[order])


def _signer(equal: _Parts, unequal: _Parts):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch.column(0), batch.column(1)
            for first, texts in textarrays.chunks(words, _CHUNK):
                rows, sigs, sides = _signatures(texts, equal, unequal)
                place = pa.array(first + rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sigs.view(np.int64)), pa.array(sides), words.take(place), counts.take(place)],
                    names=["sig", "side", "word", "n"],
                )

    return task


def _signatures(texts: textarrays.Texts, equal: _Parts, unequal: _Parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, signature and side of every signature of every text."""
    n = len(texts)
    owner, places = _places(texts)
    length = np.bincount(owner, minlength=n).astype(np.uint64)
    every = np.arange(n)
    rows, sigs, sides = [], [], []

    def add(sums: np.ndarray, leave: int, salt: np.ndarray, side: int) -> None:
        parts = sums.shape[1]
        for i, some in enumerate(combinations(range(parts), parts - leave)):
            sig = mix(salt * np.uint64(1024) + np.uint64(i))
            for part in some:
                sig = combine(sig, sums[:, part])
            rows.append(every)
            sigs.append(sig)
            sides.append(np.full(n, side, np.int8))

    add(_part_sums(owner, places, n, equal), 2, length * np.uint64(2), _BOTH)
    sums = _part_sums(owner, places, n, unequal)
    # The salt is the length of the pair's shorter word.
    add(sums, 1, length * np.uint64(2) + np.uint64(1), _SHORTER)
    add(sums, 1, length * np.uint64(2) - np.uint64(1), _LONGER)
    return np.concatenate(rows), np.concatenate(sigs), np.concatenate(sides)


def _places(texts: textarrays.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every place that a text's vector has a one in: a code point and its occurrence number."""
    data = texts.data
    heads = np.flatnonzero(texts.characters())
    owner = texts.row_of(heads)
    ends = np.append(heads[1:], len(data))
    points = np.zeros(len(heads), np.uint64)
    for step in range(4):
        has = heads + step < ends
        points[has] = points[has] << np.uint64(8) | data[heads[has] + step]
    order = np.lexsort((points, owner))
    owner, points = owner[order], points[order]
    begins = np.ones(len(points), bool)
    begins[1:] = (owner[1:] != owner[:-1]) | (points[1:] != points[:-1])
    starts = np.flatnonzero(begins)
    nth = np.arange(len(points)) - np.repeat(starts, np.diff(np.append(starts, len(points))))
    return owner, combine(points, nth.astype(np.uint64))


def _part_sums(owner: np.ndarray, places: np.ndarray, n: int, parts: _Parts) -> np.ndarray:
    """For each row and part the sum of the hashes of its places: equal for equal sets, whatever their order."""
    sums = np.zeros(n * parts.count, np.uint64)
    np.add.at(sums, owner * parts.count + parts.of(places), places)
    return sums.reshape(n, parts.count)
