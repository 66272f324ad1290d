"""Look-ups in tables of unknown size that stay even when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot if it has at least this share of all rows, so there are at most 1000 hot keys.
_HOT_KEYS = 1000
# Tables counted and found to have at most this many keys are broadcast whole.
SMALL_TABLE = 200_000
_KEY = "_lookup_key"


def lookup(
    df: DataFrame,
    key: Column,
    table: DataFrame,
    table_key: str,
    values: Sequence[str],
    weight: str,
    table_rows: int | None = None,
) -> DataFrame:
    """Left join of ``df`` with one row per key of ``table``; ``weight`` is the key's row count.

    Hot keys are found by broadcasting their few table rows. All other keys are joined by shuffle;
    there, rows with a hot key get a key of their own that matches nothing, so they spread over
    all tasks instead of meeting in one. Pass ``table_rows`` where the table has been counted: a
    small one is then broadcast whole.
    """
    if table_rows is not None and table_rows <= SMALL_TABLE:
        slim = table.select(F.col(table_key).alias("_table_key"), *values)
        return df.join(F.broadcast(slim), key.cast("string") == F.col("_table_key"), "left").drop(
            "_table_key"
        )
    hot_from = table.agg(F.sum(weight) / F.lit(_HOT_KEYS)).scalar()
    is_hot = F.col(weight) >= hot_from
    hot = table.filter(is_hot).select(
        F.col(table_key).alias("_hot_key"), *[F.col(v).alias(f"_hot_{v}") for v in values]
    )
    # Marks keep real keys and made-up ones apart.
    cold = table.filter(~is_hot).select(
        F.concat(F.lit("="), F.col(table_key)).alias("_cold_key"), *[F.col(v).alias(f"_cold_{v}") for v in values]
    )
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    made_up = F.concat(F.lit("~"), row_hash.cast("string"))
    columns = df.columns
    keyed = df.withColumn(_KEY, key.cast("string"))
    # At most 1000 rows are broadcast, by the definition of hot.
    known = keyed.join(F.broadcast(hot), F.col(_KEY) == F.col("_hot_key"), "left")
    apart = F.when(F.col("_hot_key").isNotNull(), made_up).otherwise(F.concat(F.lit("="), F.col(_KEY)))
    joined = known.withColumn(_KEY, apart).join(cold, F.col(_KEY) == F.col("_cold_key"), "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in columns],
        *[F.coalesce(f"_hot_{v}", f"_cold_{v}").alias(v) for v in values],
    )
