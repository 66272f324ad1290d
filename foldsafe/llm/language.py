"""Language identification with one Bloom filter whose slots hold a bit per language.

Training counts the n-grams of `GRAM` bytes (letters lower-cased, everything else a space) per language
over all labelled training texts. A language contains an n-gram if the n-gram makes up at least
`FLOOR` of the language's n-grams and comes at least `NEAR` times as often there as in the language
where it is most frequent. By `FLOOR` a language has at most 1 / FLOOR n-grams, which bounds the
filter's fill whatever the corpus. Each n-gram sets its languages' bits in `HASHES` slots.

Looking up an n-gram is the bitwise and of its slots: all languages that contain it at once. A text's
hits per language are counted, and the hits that the filter's fill would give to unknown n-grams are
taken off: (hits - n * f) / (1 - f), f = fill of the language's bits to the power HASHES. The largest
count decides; ties go to the language with more training text, then by name. The score is that count
over the text's n-grams.

Only counts move: each task sums its own (language, n-gram) counts first. The filter has 8 * SLOTS
bytes per 64 languages and is the only thing collected and broadcast.

Null text, or text without a letter: `und`, score 0. A text too short for an n-gram gets the language
with most training text, score 0; so does any text none of whose n-grams are known. Without training
texts all is `und`. Rows with a null label are not learned from. Repeated rows count as often as they
come. Only the key columns and the results are returned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsafe.llm import textarrays
from foldsafe.llm.textarrays import Texts, mix
from foldsafe.sources import scratch

GRAM = 5
FLOOR = 1e-5
NEAR = 0.3
SLOTS = 1 << 20
HASHES = 3
UNKNOWN = "und"
_KEEP = 4_000_000


def _normal() -> np.ndarray:
    table = np.full(256, 0x20, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


_NORMAL = _normal()


def grams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Every n-gram without two spaces in a row, as an integer of its bytes, and its row."""
    data = _NORMAL[texts.data]
    if len(data) < GRAM:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # Capital letters of Latin-1 in UTF-8: C3 80 to C3 9E.
    capital = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
    data[capital] += 0x20
    n = len(data) - GRAM + 1
    space = data == 0x20
    twice = space[1:] & space[:-1]
    bad = np.zeros(n, bool)
    for i in range(GRAM - 1):
        bad |= twice[i: i + n]
    inner = texts.offsets[1:-1]
    for i in range(1, GRAM):
        at = inner - i
        bad[at[(at >= 0) & (at < n)]] = True
    starts = np.flatnonzero(~bad)
    made = np.zeros(n, np.uint64)
    for i in range(GRAM):
        made = (made << np.uint64(8)) | data[i: i + n]
    return made[starts], texts.row_of(starts)


def slots(keys: np.ndarray) -> list[np.ndarray]:
    hashed = mix(keys * np.uint64(0x9E3779B97F4A7C15))
    width = SLOTS.bit_length() - 1
    return [((hashed >> np.uint64(width * i)) & np.uint64(SLOTS - 1)).astype(np.int64) for i in range(HASHES)]


@dataclass(frozen=True)
class Filter:
    """`masks[w][slot]`: bits of the languages 64 w to 64 w + 63; languages in order of preference."""

    languages: list[str]
    masks: np.ndarray

    def false_rates(self) -> np.ndarray:
        fills = [
            np.count_nonzero(self.masks[i // 64] >> np.uint64(i % 64) & np.uint64(1)) / SLOTS
            for i in range(len(self.languages))
        ]
        return np.array(fills) ** HASHES


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[heads], np.add.reduceat(count, heads) if len(heads) else count


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, n-gram); handed out and forgotten whenever many distinct ones are held."""
    names: dict[str, int] = {}
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    for batch in batches:
        labels = np.array([names.setdefault(x, len(names)) for x in batch.column(1).to_pylist()], np.uint64)
        for first, texts in textarrays.chunks(batch.column(0)):
            found, rows = grams(texts)
            packed = found | labels[first + rows] << np.uint64(8 * GRAM)
            packed.sort()
            heads = np.flatnonzero(np.append(True, packed[1:] != packed[:-1])) if len(packed) else np.zeros(0, np.int64)
            keys.append(packed[heads])
            counts.append(np.diff(np.append(heads, len(packed))))
            if sum(map(len, keys)) > _KEEP:
                summed = _summed(keys, counts)
                keys, counts = [summed[0]], [summed[1]]
                # Less than half of the room left: the next sums would come ever sooner.
                if 2 * len(summed[0]) > _KEEP:
                    yield from _counted(*summed, names)
                    keys, counts = [], []
    if keys:
        yield from _counted(*_summed(keys, counts), names)


def _counted(key: np.ndarray, count: np.ndarray, names: dict[str, int]) -> Iterator[pa.RecordBatch]:
    words = pa.array(list(names), pa.string())
    step = 100_000
    for i in range(0, len(key), step):
        part = key[i: i + step]
        yield pa.RecordBatch.from_arrays(
            [
                words.take(pa.array((part >> np.uint64(8 * GRAM)).astype(np.int64))),
                pa.array((part & np.uint64((1 << 8 * GRAM) - 1)).astype(np.int64)),
                pa.array(count[i: i + step]),
            ],
            names=["lang", "gram", "n"],
        )


def _slot_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).to_numpy().astype(np.uint64)
        places = slots(keys)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(places))]
            + [pa.concat_arrays([batch.column(i)] * HASHES) for i in (1, 2)],
            names=["slot", "word", "mask"],
        )


def learn(df: DataFrame, text: str = "text", label: str = "lang") -> Filter:
    """The filter of all rows with a text and a label."""
    rows = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").cast("string").alias("lang"))
    counted = rows.where("text IS NOT NULL AND lang IS NOT NULL").mapInArrow(_count_task, "lang string, gram long, n long")
    summed = scratch.written(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    totals = summed.groupBy("lang").agg(F.sum("n").alias("total")).collect()
    order = sorted(totals, key=lambda r: (-r["total"], r["lang"]))
    words = max(1, -(-len(order) // 64))
    masks = np.zeros((words, SLOTS), np.uint64)
    if order:
        spark = df.sparkSession
        known = spark.createDataFrame(
            [(r["lang"], float(r["total"]), i) for i, r in enumerate(order)], "lang string, total double, code int"
        )
        rated = summed.join(F.broadcast(known), "lang").select("gram", "code", (F.col("n") / F.col("total")).alias("rate"))
        best = rated.groupBy("gram").agg(F.max("rate").alias("best"), F.collect_list(F.struct("code", "rate")).alias("all"))
        holds = best.select("gram", "best", F.explode("all").alias("one")).where(
            (F.col("one.rate") >= FLOOR) & (F.col("one.rate") >= NEAR * F.col("best"))
        )
        code = F.col("one.code")
        bit = F.expr("shiftleft(1L, one.code % 64)")
        masked = holds.groupBy("gram", F.floor(code / 64).alias("word")).agg(F.bit_or(bit).alias("mask"))
        placed = masked.mapInArrow(_slot_task, "slot long, word long, mask long")
        table = placed.groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
        slot, word, mask = (table.column(c).to_numpy() for c in ("slot", "word", "mask"))
        masks[word, slot] = mask.view(np.uint64)
    return Filter([r["lang"] for r in order], masks)


def _scored(texts: Texts, found: Filter, rates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's language (-1: und) and its score."""
    n = len(texts)
    keys, rows = grams(texts)
    totals = np.bincount(rows, minlength=n)
    best, choice = np.zeros(n), np.zeros(n, np.int64)
    places = slots(keys)
    for w in range(len(found.masks)):
        seen = found.masks[w][places[0]]
        for p in places[1:]:
            seen &= found.masks[w][p]
        for i in range(64 * w, min(64 * w + 64, len(found.languages))):
            has = (seen >> np.uint64(i % 64) & np.uint64(1)).astype(bool)
            hits = np.bincount(rows[has], minlength=n)
            count = (hits - totals * rates[i]) / max(1 - rates[i], 1e-9)
            more = count > best
            best[more], choice[more] = count[more], i
    lettered = texts.sums((_NORMAL[texts.data] >= 97) & (texts.data < 0x80)) > 0
    for i in np.flatnonzero(~lettered):
        lettered[i] = any(c.isalpha() for c in texts.text(i))
    choice[~lettered] = -1
    if not found.languages:
        choice[:] = -1
    score = np.where(choice < 0, 0.0, np.minimum(1.0, best / np.maximum(totals, 1)))
    return choice, score


def predict(df: DataFrame, found: Filter, keys: Sequence[Column], text: str = "text") -> DataFrame:
    """The key columns of every row with `lang_pred` and `score`."""
    shared = df.sparkSession.sparkContext.broadcast((found, found.false_rates()))
    picked = df.select(*keys, F.col(f"`{text}`").alias("_predicted_text"))
    fields = picked.schema.fields[:-1]
    schema = T.StructType(
        fields + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )
    order = schema.names

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, rates = shared.value
        names = pa.array([UNKNOWN, *filter_.languages], pa.string())
        for batch in batches:
            parts = [_scored(t, filter_, rates) for _, t in textarrays.chunks(batch.column(len(fields)))]
            choice = np.concatenate([p[0] for p in parts] + [np.zeros(0, np.int64)])
            score = np.concatenate([p[1] for p in parts] + [np.zeros(0)])
            columns = [batch.column(i) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays(
                columns + [names.take(pa.array(choice + 1)), pa.array(score)], names=order
            )

    return picked.mapInArrow(task, schema)


def held_out(identity: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether a row belongs to the part that is never learned from, by a checksum of its id."""
    return F.crc32(F.coalesce(F.col(f"`{identity}`").cast("string"), F.lit(""))) % folds == fold
