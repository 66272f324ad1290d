"""Sums of arrays that tasks hand out as bytes, added up in a fixed order through a tree of small groups.

A task gives one array of little-endian doubles per key, with its number. Groups of at most `FAN_IN`
arrays are added at a time, in the order of those numbers: no task ever holds more, and the same parts
always give the same sum, bit for bit, whichever of them arrives first.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAN_IN = 64
PART, BODY = "part", "body"


def summed(parts: DataFrame, keys: Sequence[str], n_parts: int, down_to: int = 1) -> DataFrame:
    """The columns ``keys``, ``part`` and ``body`` with at most ``down_to`` parts per key.

    ``parts`` has the same columns, ``part`` a long from 0 to below ``n_parts``; arrays of a key are equally long.
    """
    while n_parts > down_to:
        n_parts = -(-n_parts // FAN_IN)
        kinds = {f.name: f.dataType for f in parts.schema.fields}
        schema = T.StructType([T.StructField(k, kinds[k]) for k in keys] + [
            T.StructField(PART, T.LongType()), T.StructField(BODY, T.BinaryType())
        ])
        named = parts.select(*keys, PART, F.expr(f"{PART} DIV {FAN_IN}").alias("_group"), BODY)
        parts = named.groupBy(*keys, "_group").applyInArrow(_adder(list(keys)), schema)
    return parts


def _adder(keys: list[str]):
    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column(PART).to_numpy(), kind="stable")
        bodies = table.column(BODY)
        total = array_of(bodies[int(order[0])].as_buffer()).copy()
        for i in order[1:].tolist():
            total += array_of(bodies[i].as_buffer())
        out = {k: table.column(k).slice(0, 1) for k in keys}
        out[PART] = table.column("_group").slice(0, 1)
        out[BODY] = pa.array([total.tobytes()], pa.binary())
        return pa.table(out)

    return add


def collected(parts: DataFrame, n_parts: int) -> np.ndarray | None:
    """The sum of all parts (no keys) on the driver, which gets at most ``FAN_IN`` arrays; None without parts."""
    rows = summed(parts, [], n_parts, FAN_IN).select(PART, BODY).collect()
    total = None
    for row in sorted(rows, key=lambda r: r[PART]):
        total = array_of(row[BODY]) if total is None else total + array_of(row[BODY])
    return total


def array_of(body) -> np.ndarray:
    return np.frombuffer(body, "<f8")
