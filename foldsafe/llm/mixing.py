"""Mixing sources to target weights by hash thresholds.

Sources in the order of their names (code points, null last) weigh 5, 2, 1, repeating. They share a
part of all words by weight; no source gives more than `most` times its own words, and what it cannot
give is shared again by weight. A target of 2.4 times a source means every document twice, and those
documents a third time whose hash is below a threshold that leaves 0.4 of the source's words.

The threshold comes from histograms: words per source and hash bucket are summed (after partial sums
in every task), the bucket that holds the budget's end is found, and only its documents are counted
again in finer buckets, until one hash value is left. It goes in if that comes nearer to the budget.
No rows are sorted, a smaller budget keeps a subset of a larger one's documents, and the hash depends
on the document's id alone, so reruns agree.

A source may hold any share of the rows: sums are combined in the tasks, and rows meet their source's
plan by a broadcast of a counted table, or by a join that Spark can split. Null text has size 0; a
null source is a source; rows with equal ids are taken together; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldsafe.sources import scratch

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"
_BITS = 60
_STEP = 10
# A plan is broadcast if counted and found to have at most this many sources and characters in names.
_FEW_SOURCES = 10_000
_FEW_CHARACTERS = 4_000_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(identity: Column, seed: int = SEED) -> Column:
    """60 bits of a digest of the id; SQL engines can compute it too."""
    digest = F.md5(F.concat(F.coalesce(identity.cast("string"), F.lit("")), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("long")


def _key(source: Column) -> Column:
    """Source names as join keys that are never null; null sorts last."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("z"))


def sized(df: DataFrame, keys: Sequence[str], identity: str, source: str, text: str) -> DataFrame:
    """One narrow row per document, written once: everything else works on it, not on the texts."""
    return scratch.written(
        df.select(
            *[F.col(f"`{k}`").alias(f"_out{i}") for i, k in enumerate(keys)],
            _key(F.col(f"`{source}`")).alias("_source"),
            hash_of(F.col(f"`{identity}`")).alias("_hash"),
            size_of(F.col(f"`{text}`")).alias("_size"),
        ),
        "mix-sizes",
    )


def ranked(sources: DataFrame) -> DataFrame:
    """Add the 0-based position of each source in sorted order, without a one-task sort."""
    row = F.monotonically_increasing_id()
    ordered = scratch.written(
        sources.sort("_source").withColumns({"_part": F.spark_partition_id(), "_row": row}), "mix-order"
    )
    # One row per partition of the sort.
    parts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    parts = parts.select("_part", "_first", before.alias("_before"))
    placed = ordered.join(F.broadcast(parts), "_part")
    return placed.withColumn("_rank", F.col("_row") - F.col("_first") + F.col("_before")).drop(
        "_part", "_row", "_first", "_before"
    )


def targets(sizes: DataFrame, weights: Sequence[int], most: int, share: float) -> DataFrame:
    """`_source`, `_source_size` and `_target` of every source, written."""
    sources = sizes.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = scratch.written(ranked(sources).select("_source", "_source_size", weight.alias("_weight")), "mix-sources")
    total = (table.agg(F.sum("_source_size")).first()[0] or 0) * share
    most_words = F.col("_source_size") * most
    level = -1.0
    while True:
        full = F.lit(level) * F.col("_weight") > most_words
        fixed, open_weight = table.agg(
            F.coalesce(F.sum(F.when(full, most_words)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0)),
        ).first()
        if not open_weight:
            level = float("inf")
            break
        found = (total - fixed) / open_weight
        if found == level:
            break
        level = found
    even = F.when(F.col("_source_size") > 0, F.lit(level) * F.col("_weight")).otherwise(F.lit(0.0))
    return table.select("_source", "_source_size", F.least(most_words.cast("double"), even).alias("_target"))


def attach(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Join rows with a written table of one row per source."""
    count, characters = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("_source")), F.lit(0))).first()
    if count <= _FEW_SOURCES and characters <= _FEW_CHARACTERS:
        table = F.broadcast(table)
    return rows.join(table, "_source")


def plan(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, share: float = 1.0
) -> DataFrame:
    """Per source: size, target, whole copies of every document, and the hash below which one more is taken."""
    aims = targets(sizes, weights, most, share)
    copies = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(F.lit(0))
    base = aims.withColumn("_copies", copies.cast("long"))
    state = scratch.written(
        base.withColumns({
            "_extra": F.col("_target") - F.col("_copies") * F.col("_source_size"),
            "_prefix": F.lit(0).cast("long"),
            "_below": F.lit(0).cast("long"),
            "_threshold": F.lit(None).cast("long"),
        }).withColumn("_threshold", F.when(F.col("_extra") <= 0, F.lit(0).cast("long"))),
        "mix-state",
    )
    shift = _BITS
    while shift > 0 and not state.where(F.col("_threshold").isNull()).isEmpty():
        state = scratch.written(_refined(sizes, state, shift - _STEP), "mix-state")
        shift -= _STEP
    return state.select("_source", "_source_size", "_target", "_copies", "_threshold")


def _refined(sizes: DataFrame, state: DataFrame, shift: int) -> DataFrame:
    """Narrow the bucket that holds each open budget's end by one step."""
    open_ = state.where(F.col("_threshold").isNull())
    inside = attach(sizes, open_).where(F.shiftright("_hash", shift + _STEP) == F.col("_prefix"))
    carried = ["_source", "_source_size", "_target", "_copies", "_extra", "_below"]
    buckets = inside.groupBy(*carried, F.shiftright("_hash", shift).alias("_bucket")).agg(
        F.sum("_size").alias("_words"), F.min("_hash").alias("_low"), F.max("_hash").alias("_high")
    )
    run = Window.partitionBy("_source").orderBy("_bucket")
    until = F.col("_below") + F.sum("_words").over(run)
    first = F.row_number().over(run)
    edge = (
        buckets.withColumn("_until", until)
        .where(F.col("_until") > F.col("_extra"))
        .withColumn("_place", first)
        .where("_place = 1")
    )
    before = F.col("_until") - F.col("_words")
    nearer = (F.col("_until") - F.col("_extra")) < (F.col("_extra") - before)
    settled = F.when(F.col("_low") == F.col("_high"), F.col("_low") + nearer.cast("long"))
    found = edge.select(
        *carried[:-1], F.col("_bucket").alias("_prefix"), before.alias("_below"), settled.alias("_threshold")
    )
    return state.where(F.col("_threshold").isNotNull()).unionByName(found)


def taken_copies() -> Column:
    return (F.col("_copies") + (F.col("_hash") < F.col("_threshold")).cast("long")).cast("long")


def mix_report(
    df: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    identity: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    share: float = 1.0,
) -> DataFrame:
    """The keys of every document with `size`, `source_size`, `target`, `copies` and `taken` words."""
    sizes = sized(df, keys, identity, source, text)
    copies = taken_copies()
    return attach(sizes, plan(sizes, weights, most, share)).select(
        *[F.col(f"_out{i}").alias(k) for i, k in enumerate(keys)],
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        copies.alias("copies"),
        (copies * F.col("_size")).alias("taken"),
    )


def mixed(
    df: DataFrame,
    identity: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST,
    share: float = 1.0,
) -> DataFrame:
    """The documents of the mix, each repeated as often as it is taken, in the columns they came with."""
    planned = plan(sized(df, (), identity, source, text), weights, most, share)
    slim = planned.select("_source", "_copies", "_threshold")
    columns = [F.col(f"`{c}`") for c in df.columns]
    marked = df.select(
        F.struct(*columns).alias("_document"),
        _key(F.col(f"`{source}`")).alias("_source"),
        hash_of(F.col(f"`{identity}`")).alias("_hash"),
    )
    repeated = attach(marked, slim).withColumn("_times", taken_copies()).where("_times > 0")
    return repeated.select("_document", F.explode(F.sequence(F.lit(1), "_times"))).select("_document.*")
