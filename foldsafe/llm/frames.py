"""Running a function over Arrow batches while other columns pass through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Keep = Callable[[pa.RecordBatch], dict[str, pa.Array]]


def keep_names(names: list[str]) -> Keep:
    return lambda batch: {n: batch.column(batch.schema.get_field_index(n)) for n in names}


def mapped(df: DataFrame, made: Keep, schema: T.StructType, kept: Keep) -> DataFrame:
    """One result row per row: the kept columns and the made ones, in the order of the schema."""
    order = schema.names

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = kept(batch) | made(batch)
            yield pa.RecordBatch.from_arrays([columns[n] for n in order], names=order)

    return df.mapInArrow(task, schema)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name the frame does not have yet, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def compact(df: DataFrame, rows: int, per_task: int = 200_000) -> DataFrame:
    """The same rows in as many partitions as so many rows need: small tables in few files."""
    return df.coalesce(max(1, -(-rows // per_task)))
