"""CSV scan and sink with the blank markers and type rules of a data-frame reader.

Blank markers become null; a column of whole numbers with blanks becomes double; dates stay text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsafe.errors import SchemaError

# The texts that count as a missing value.
BLANKS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
_WHOLE = r"^\s*[+-]?\d+\s*$"
_TRUTH = ("True", "False", "TRUE", "FALSE", "true", "false")


def _text(name: str) -> Column:
    value = F.col(f"`{name}`")
    return F.when(~value.isin(*BLANKS), value)


def _infer(raw: DataFrame) -> list[T.DataType]:
    """Types from one aggregate over the whole file: never from a sample or a prefix."""
    checks = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(raw.columns):
        text = F.col(f"`{name}`")
        whole = F.when(text.rlike(_WHOLE), text.try_cast("bigint"))
        checks += [
            F.count(text).alias(f"filled_{i}"),
            F.count(whole).alias(f"whole_{i}"),
            F.count(text.try_cast("double")).alias(f"real_{i}"),
            F.count(F.when(text.isin(*_TRUTH), text)).alias(f"truth_{i}"),
        ]
    seen = raw.agg(*checks).first()
    types: list[T.DataType] = []
    for i in range(len(raw.columns)):
        filled = seen[f"filled_{i}"]
        if filled and seen[f"whole_{i}"] == filled:
            types.append(T.LongType() if filled == seen["rows"] else T.DoubleType())
        elif seen[f"real_{i}"] == filled and seen["rows"]:
            types.append(T.DoubleType())
        elif filled == seen["rows"] and seen[f"truth_{i}"] == filled and filled:
            types.append(T.BooleanType())
        else:
            types.append(T.StringType())
    return types


def read(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Scan CSV files with a header.

    Columns are found by their header; a schema picks and orders them, and a name no header has is an
    error. With a schema only a header is read ahead; without one a single aggregate finds the types
    first. Set ``multiline`` only if quoted fields hold line breaks: such files cannot be split over
    tasks.
    """
    # Files whose header differs from the first one's are an error, not shifted columns.
    options = {"header": True, "escape": '"', "multiLine": multiline, "enforceSchema": False}
    raw = spark.read.options(**options).csv(path)
    wanted = raw.columns if schema is None else schema.names
    missing = [c for c in wanted if c not in raw.columns]
    if missing:
        raise SchemaError(f"no header for column {', '.join(missing)}")
    raw = raw.select([_text(c).alias(c) for c in wanted])
    types = [f.dataType for f in schema] if schema is not None else _infer(raw)
    return raw.select(
        [F.col(f"`{c}`").try_cast(t).alias(c) for c, t in zip(raw.columns, types)]
    )


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header and no index, quotes doubled, text as it is; one file per task."""
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).options(header=True, escape='"', **keep).csv(path)


def append(df: DataFrame, old_path: str | None, new_path: str, multiline: bool = True) -> DataFrame:
    """Old rows plus new ones, columns matched by name, written as a new version.

    Unless told otherwise it expects line breaks in text, so nothing is torn.

    A table being read is never overwritten, so a failed job leaves the old version whole.
    """
    spark = df.sparkSession
    both = df
    if old_path is not None:
        both = read(spark, old_path, multiline=multiline).unionByName(df, allowMissingColumns=True)
    write(both, new_path)
    return read(spark, new_path, multiline=multiline)
