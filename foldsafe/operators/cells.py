"""Order-preserving cells: the coarse level of every two-level rank and running total.

Sorting a whole table in one task does not scale, and a window without a partition key does just
that. So rows first get a cell such that cells are in the order of the key. Counting rows per cell
gives each cell its offset; the fine order is then only needed inside a cell. The number of cells
depends on the session's shuffle partitions, never on the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsafe.errors import SchemaError

CELL = "_cell"
_CELLS_PER_TASK = 8
_MOST_HASH_DIGITS = 5
_MOST_CELLS = 8192


def shuffle_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_digits(spark: SparkSession) -> int:
    """Leading hex digits that give some cells per shuffle task (256 to about a million cells)."""
    digits = 2
    while 16**digits < _CELLS_PER_TASK * shuffle_tasks(spark) and digits < _MOST_HASH_DIGITS:
        digits += 1
    return digits


def hash_cell(key: Column, digits: int) -> Column:
    """Cell of a hash key; hashes are uniform, so no cell is hot whatever the ids look like."""
    return F.substring(key, 1, digits)


def _local_micros(moment: Column) -> Column:
    """Microseconds of a time without zone. No session zone is involved: its summer-time shift would
    put an hour of a year out of order."""
    day = F.unix_date(moment.cast("date")).cast("bigint")
    micros = (F.date_part(F.lit("SECOND"), moment) * 1_000_000).cast("bigint")
    clock = (F.hour(moment) * 60 + F.minute(moment)).cast("bigint")
    return (day * 1440 + clock) * 60_000_000 + micros


def ordinal(column: Column, data_type: T.DataType) -> tuple[Column, Column]:
    """A double in the order of a number, date or time, and whether it tells all values apart.

    Only cells use it, never the fine order, so values may share a double.
    """
    if isinstance(data_type, T.TimestampNTZType):
        whole = _local_micros(column)
    elif isinstance(data_type, T.TimestampType):
        whole = F.unix_micros(column)
    elif isinstance(data_type, T.DateType):
        whole = F.unix_date(column)
    elif isinstance(data_type, T.IntegralType):
        whole = column
    elif isinstance(data_type, T.FractionalType):
        exact = not isinstance(data_type, T.DecimalType)
        return column.cast("double") + F.lit(0.0), F.lit(exact)
    else:
        raise SchemaError(f"rows can be ordered by a number, date or time, not {data_type.simpleString()}")
    return whole.cast("double"), F.abs(whole.cast("double")) < 2.0**53


@dataclass(frozen=True)
class NumericCells:
    """Cell edges of a numeric key, learnt from approximate quantiles.

    Edges only balance the work; results do not depend on where they lie.
    """

    edges: tuple[float, ...]

    @classmethod
    def learn(cls, df: DataFrame, key: Column) -> "NumericCells":
        wanted = min(_MOST_CELLS, _CELLS_PER_TASK * shuffle_tasks(df.sparkSession))
        probabilities = [i / wanted for i in range(1, wanted)]
        found = (
            df.select(key.alias("k"))
            .filter(F.col("k").isNotNull() & ~F.isnan("k"))
            .approxQuantile("k", probabilities, 1 / (2 * wanted))
        )
        return cls(tuple(sorted({e for e in found if math.isfinite(e)})))

    def add(self, df: DataFrame, key: Column, name: str = CELL) -> DataFrame:
        """Add the cell number; a cell holds its lower edge and all values below the next edge."""
        splits = [float("-inf"), *self.edges, float("inf")]
        held = f"{name}_key"
        cut = Bucketizer(splits=splits, inputCol=held, outputCol=name, handleInvalid="keep")
        numbered = cut.transform(df.withColumn(held, key)).drop(held)
        return numbered.withColumn(name, F.col(name).cast("int"))

    def at_edge(self, key: Column, cell: str = CELL) -> Column:
        """True where the key equals its cell's lower edge: the only values that can be hot."""
        if not self.edges:
            return F.lit(False)
        # Parsed as one text: thousands of literal objects would take longer than the job.
        edges = F.expr(f"array({', '.join(f'{e!r}D' for e in self.edges)})")
        return F.coalesce(F.try_element_at(edges, F.nullif(F.col(cell), F.lit(0))) == key, F.lit(False))
