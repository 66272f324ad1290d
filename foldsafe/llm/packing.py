"""Packing by binary decomposition: every sequence comes from one document and is full.

A document's ids and a closing id are cut into as many full sequences as fit and then into pieces
whose lengths are the powers of two in the rest, longest first. Each piece is a sequence of its own,
so no sequence crosses documents and none is padded. Sequences of equal length make up a bucket,
from which batches of one shape are drawn (`write_buckets`).

Null and empty texts are a single closing id. Every row counts as a document, repeated or not. An
empty table gives no pieces. Only the key columns and the results are returned. One narrow pass: no
shuffle, memory bounded by a batch of texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsafe.llm import encoding

LIMIT = 1024
CLOSING_ID = 0
_RESULT = [
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()),
]


def pack(
    df: DataFrame,
    tokenizer: str,
    keys: Sequence[str] = ("doc_id",),
    text: str = "text",
    limit: int = LIMIT,
    closing_id: int = CLOSING_ID,
) -> DataFrame:
    """One row per piece: the document's keys, `start`, `length`, `ids` (little-endian unsigned 32-bit),
    `doc_tokens`, `sequence_id` and `offset` in the sequence.

    `limit` is a power of two. Sequence ids are unique; they follow the table's files and rows, so a
    task that is run again gives its sequences the same ids.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    clash = {f.name for f in _RESULT} | {"sequence_id", "offset"}
    if clash & set(keys):
        raise ValueError(f"key columns cannot be called {sorted(clash & set(keys))}")
    schema = T.StructType([T.StructField(k, kinds[k]) for k in keys] + _RESULT)
    order = schema.names
    picked = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").alias("_packed_text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding.encoder(tokenizer)
        for batch in batches:
            ids, counts = encode.encode(batch.column(len(keys)))
            closed, counts = with_closing(ids, counts, closing_id)
            rows, starts, lengths = pieces(counts, limit)
            places = np.concatenate(([0], np.cumsum(lengths)))
            width = pa.array(4 * places, pa.int64()).buffers()[1]
            packed = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(rows), [None, width, pa.py_buffer(closed.astype("<u4"))]
            )
            taken = pa.array(rows, pa.int64())
            columns = [batch.column(i).take(taken) for i in range(len(keys))]
            columns += [pa.array(starts), pa.array(lengths), packed.cast(pa.binary()), pa.array(counts[rows])]
            yield pa.RecordBatch.from_arrays(columns, names=order)

    made = picked.mapInArrow(task, schema)
    return made.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def with_closing(ids: np.ndarray, counts: np.ndarray, closing_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with one more at the end of every document, and the new counts."""
    counts = counts + 1
    out = np.full(int(counts.sum()), closing_id, np.uint32)
    own = np.ones(len(out), bool)
    own[np.cumsum(counts) - 1] = False
    out[own] = ids
    return out, counts


def pieces(counts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of every piece of documents with so many ids, in order."""
    rows, lengths = [], []
    full = counts // limit
    rows.append(np.repeat(np.arange(len(counts)), full))
    lengths.append(np.full(len(rows[0]), limit, np.int64))
    power = limit // 2
    while power:
        has = np.flatnonzero(counts & power)
        rows.append(has)
        lengths.append(np.full(len(has), power, np.int64))
        power //= 2
    row, length = np.concatenate(rows), np.concatenate(lengths)
    order = np.argsort(row, kind="stable")
    row, length = row[order], length[order]
    run = np.cumsum(length) - length
    first = np.cumsum(counts) - counts
    return row, run - first[row], length


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write the sequences under one folder per length."""
    packed.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)
