"""Token counts through a cache of content digests.

Normalised content (null becomes the empty text; nothing else may change, since the counts are of the
text itself) is identified by its SHA-256, the tokenizer by the digest of its file and library. A
count already stored under both digests is looked up; of the others each distinct content is encoded
once and its count appended to the cache, a folder of Parquet files with one sub-folder per tokenizer
version. Two runs that append the same digest store equal counts, which a read takes once.

Only digests meet in joins. Texts move once, and only those without a stored count: copies are first
reduced to one per task, then one per digest, so a group of copies never gathers. A hot digest in the
last join is an ordinary skewed join, which Spark splits.

Empty and null texts have a count of 0. Repeated rows each get their row. An empty table gives an
empty result. Only the key columns and the results are returned, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsafe.llm import encoding
from foldsafe.sources import scratch

LIMIT = 1024
# At most this many digests of 32 bytes are broadcast, after counting them.
_FEW_DIGESTS = 100_000
_CACHE = "digest binary, n_tokens long"


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The stored counts of one tokenizer version, one row per digest."""
    try:
        stored = spark.read.schema(_CACHE).parquet(f"{cache}/tokenizer={version}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _CACHE)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    df: DataFrame,
    tokenizer: str,
    cache: str,
    keys: Sequence[str] = ("doc_id",),
    text: str = "text",
    limit: int = LIMIT,
) -> DataFrame:
    """The keys of every row with `n_bytes`, `n_tokens` and `over_limit` (more tokens than the limit)."""
    spark = df.sparkSession
    version = encoding.version(tokenizer)
    content = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(content, 256))
    rows = scratch.written(
        df.select(
            *[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)],
            digest.alias("digest"),
            F.octet_length(content).cast("long").alias("n_bytes"),
        ),
        "token-rows",
    )
    digests = rows.select("digest").distinct()
    known = cached(spark, cache, version)
    missing = scratch.written(digests.join(known, "digest", "left_anti"), "token-misses")
    n_missing = missing.count()
    if n_missing:
        texts = df.select(digest.alias("digest"), content.alias("content"))
        if n_missing <= _FEW_DIGESTS:
            texts = texts.join(F.broadcast(missing), "digest", "left_semi")
            texts = texts.groupBy("digest").agg(F.first("content").alias("content"))
        else:
            texts = texts.groupBy("digest").agg(F.first("content").alias("content"))
            texts = texts.join(missing, "digest", "left_semi")
        counts = texts.mapInArrow(_counter(tokenizer), _CACHE)
        counts.write.mode("append").parquet(f"{cache}/tokenizer={version}")
    # Written, so that the join below has plain inputs on both sides and skew can be split.
    found = scratch.written(
        digests.join(cached(spark, cache, version), "digest").select("digest", "n_tokens"), "token-counts"
    )
    return rows.join(found, "digest", "left").select(
        *[F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)],
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )


def _counter(tokenizer: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding.encoder(tokenizer)
        for batch in batches:
            counts = pa.array(encode.count(batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], names=["digest", "n_tokens"])

    return task
