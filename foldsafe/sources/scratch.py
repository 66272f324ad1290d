"""Where intermediate tables go.

On a cluster this is the shared folder the cluster names in ``spark.checkpoint.dir``. A folder of
our own is made only where that is unset and the session runs on one machine, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsafe.errors import SchemaError

SETTING = "spark.checkpoint.dir"
# Rows in a part of a table that is dealt out.
_PART_ROWS = 1 << 18
# Bytes of a row group, and of what is handed to Python at a time, of tables whose rows are blocks of bytes.
_GROUP_BYTES, _BATCH_BYTES = 8 << 20, 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_root(spark: SparkSession) -> str:
    context = spark.sparkContext
    named = context.getConf().get(SETTING, None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise SchemaError(f"set {SETTING} to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="foldsafe-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path nobody has written to yet."""
    return f"{shared_root(spark)}/foldsafe/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table in the shared folder: lineage ends here.

    Later jobs then start from files, so losing an executor costs a re-read, not a re-computation.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _small_batches(spark: SparkSession) -> SparkSession:
    """A session with the settings of this one that hands blocks to Python in batches of at most `_BATCH_BYTES` and a row."""
    if int(spark.conf.get(_BATCH_SETTING).removesuffix("b")) <= _BATCH_BYTES:
        return spark
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if name.startswith("spark.sql.") and spark.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set(_BATCH_SETTING, f"{_BATCH_BYTES}b")
    return own


def blocks(df: DataFrame, name: str) -> DataFrame:
    """`written` for a table whose rows are blocks of many bytes, to be read by tasks in Python.

    Spark holds a row group of such a table, and a batch of its rows, whole, several times over. Counted in rows, as usual, these
    would be as large as a part of the table; here both have a size in bytes. The settings of the session of ``df`` stay.
    """
    path = new_path(df.sparkSession, name)
    # Sizes are looked at every few rows, not every hundred.
    df.write.options(**{"parquet.block.size": _GROUP_BYTES, "parquet.page.size.row.check.min": 4}).parquet(path)
    return _small_batches(df.sparkSession).read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table of even parts, one per core at least, written to the shared folder once.

    Worth it for a table that many passes read and that comes from few files or a join: its tasks are then as many as
    the cores, and the join runs once. Rows go by a hash of all their columns, so neither blank nor repeated keys meet.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, -(-df.count() // _PART_ROWS))
    return written(df.repartition(parts, *[F.col(f"`{c}`") for c in df.columns]), name)
