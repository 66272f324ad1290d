"""Tables whose size is fixed by the job's parameters, built without Python rows."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def rows_of(structs: Sequence[Column]) -> Column:
    """Generator that turns a list of equal structs into rows."""
    return F.inline(F.array(*structs))


def table(spark: SparkSession, schema: str, rows: Sequence[Sequence[Any]]) -> DataFrame:
    """Literal rows under a ``name type, …`` schema."""
    fields = [part.strip().split(" ", 1) for part in schema.split(",")]
    structs = [
        F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields)])
        for row in rows
    ]
    if not structs:
        return spark.createDataFrame([], schema)
    return spark.range(1).select(rows_of(structs))
