"""Chat logs: keep conversations that no longer one starts with, and render them.

Services log a conversation again after each turn, so most logged conversations are prefixes of later
snapshots. Every turn gets a rolling hash of the turns up to it (128 bits; the exclusive or of hashes
of position, role and text, so blocks of a long conversation are hashed apart and put together). A
conversation is dropped if its last rolling hash is that of a turn inside another conversation (left
anti join), and of conversations with equal turns the one with the smallest id is kept. Only the kept
ones are joined with their texts and rendered.

Turns are ordered by number (null last), then by content. A row that repeats conversation, turn, role
and text counts once. Null role or text is its own value in hashes and renders as empty. Rows without
a conversation id form one conversation. Extra columns are ignored. An empty table renders nothing.

Conversations of any length are handled in blocks of `BLOCK` turn numbers, and a block with more than
`BLOCK` distinct turns (null or repeated numbers) in blocks of so many positions. Each is rendered as a
segment of its own, so no task holds a whole conversation; segments in order are the rendered
conversation, and conversations within one block have the single segment 0. Positions come from counts
per conversation, turn number and range of hashes. The check SQL has one segment per block of turn
numbers: it is the same up to `BLOCK` distinct turns in a block, and one row without bound beyond.
Equal prefixes are reduced to one per task before they move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
BEFORE_ROLE, AFTER_ROLE, AFTER_TEXT = "<|", "|>\n", "<|end|>\n"
_NO_TURN = (1 << 62) - 1
_CELL_BITS = 12  # of a turn's hash: turns with one number are placed by so many cells
_ID = ["conv", "block", "turn", "h1", "h2"]


def _turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    parts = [F.col(f"`{c}`").cast("string") for c in (role, text)]
    whole = [F.coalesce(F.concat(F.lit("v"), p), F.lit("n")) for p in parts]
    number = F.coalesce(F.col(f"`{turn}`").cast("long"), F.lit(_NO_TURN))
    return df.select(
        F.col(f"`{conv}`").alias("conv"),
        number.alias("turn"),
        F.floor(number / BLOCK).alias("block"),
        F.xxhash64(*whole).alias("h1"),
        F.xxhash64(F.lit(1), *reversed(whole)).alias("h2"),
        parts[0].alias("role"),
        parts[1].alias("text"),
    )


def _xor(name: str) -> Column:
    return F.bit_xor(name)


def positions(turns: DataFrame) -> DataFrame:
    """Distinct turns with `pos`, their place in the conversation from 1, and `part`, their block of positions in `block`."""
    light = turns.select(*_ID).distinct().withColumn("cell", F.shiftright("h1", 64 - _CELL_BITS))
    keys, places = ["conv", "block"], ["conv", "block", "turn", "cell"]
    counts = light.groupBy(*places).agg(F.count(F.lit(1)).alias("n"))
    by_cell = Window.partitionBy(*keys).orderBy("turn", "cell").rowsBetween(Window.unboundedPreceding, 0)
    by_block = Window.partitionBy("conv").orderBy("block")
    blocks = counts.groupBy(*keys).agg(F.sum("n").alias("n")).select(
        *keys, (F.sum("n").over(by_block) - F.col("n")).alias("first")
    )
    cells = _join(counts.withColumn("inner", F.sum("n").over(by_cell) - F.col("n")).drop("n"), blocks, keys)
    inside = Window.partitionBy(*places).orderBy("h1", "h2")
    placed = _join(light, cells, places).withColumn("inner", F.col("inner") + F.row_number().over(inside))
    return placed.select(
        *_ID, (F.col("first") + F.col("inner")).alias("pos"), F.floor((F.col("inner") - 1) / BLOCK).alias("part")
    )


def rolling(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct turns with `pos`, the rolling hash before (`b1`, `b2`) and after (`p1`, `p2`) each; and the segments."""
    keys = ["conv", "block", "part"]
    placed = positions(turns).withColumns({"e1": F.xxhash64("pos", "h1"), "e2": F.xxhash64("h2", "pos")})
    totals = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), _xor("e1").alias("t1"), _xor("e2").alias("t2"))
    by_conv = Window.partitionBy("conv").orderBy("block", "part")
    segments = totals.select(
        *keys, (F.row_number().over(by_conv) - 1).alias("segment"), (F.sum("n").over(by_conv) - F.col("n")).alias("first"),
        *[F.col(f"t{i}").bitwiseXOR(_xor(f"t{i}").over(by_conv)).alias(f"s{i}") for i in (1, 2)],
    )
    until = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = _join(placed, segments.select(*keys, "s1", "s2"), keys).withColumns({
        f"p{i}": F.col(f"s{i}").bitwiseXOR(_xor(f"e{i}").over(until)) for i in (1, 2)
    })
    rows = rows.withColumns({f"b{i}": F.col(f"p{i}").bitwiseXOR(F.col(f"e{i}")) for i in (1, 2)})
    return rows.select(*_ID, "part", "pos", "p1", "p2", "b1", "b2"), segments.select(*keys, "segment", "first")


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null."""
    renamed = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return left.join(renamed, condition, how).drop(*[f"_{k}" for k in keys])


def maximal(rows: DataFrame) -> DataFrame:
    """`conv`, `n_turns` and `n_copies` of the conversations to keep, from their rolling hashes."""
    ends = rows.groupBy("conv").agg(
        F.max("pos").alias("n_turns"), F.max_by(F.struct("p1", "p2"), "pos").alias("end")
    )
    whole = ends.groupBy(F.col("end.p1").alias("p1"), F.col("end.p2").alias("p2"), "n_turns").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_copies")
    )
    inner = rows.where("pos > 1").select(
        F.col("b1").alias("p1"), F.col("b2").alias("p2"), (F.col("pos") - 1).alias("n_turns")
    )
    return whole.join(inner.distinct(), ["p1", "p2", "n_turns"], "left_anti").select("conv", "n_turns", "n_copies")


def render(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """`conv`, `segment`, `first_turn` (position from 1), `n_turns` (of the conversation), `n_copies` and the
    rendered `text` of every maximal conversation."""
    turns = _turns(df, conv, turn, role, text)
    rows, segments = rolling(turns)
    keys = ["conv", "block", "part"]
    # Conversations are chosen by segment, so that the rows of a long one are not joined by its id alone.
    chosen = _join(rows.select(*_ID, "part", "pos"), _join(segments, maximal(rows), ["conv"]), keys)
    once = turns.groupBy(*_ID).agg(F.first("role").alias("role"), F.first("text").alias("text"))
    said = _join(once, chosen, _ID).groupBy("conv", "segment", "first", "n_turns", "n_copies").agg(
        F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("said")
    )
    shown = F.transform("said", lambda s: F.concat(
        F.lit(BEFORE_ROLE), F.coalesce(s["role"], F.lit("")), F.lit(AFTER_ROLE),
        F.coalesce(s["text"], F.lit("")), F.lit(AFTER_TEXT),
    ))
    return said.select(
        F.col("conv").alias(conv), F.col("segment").cast("int").alias("segment"),
        (F.col("first") + 1).alias("first_turn"), "n_turns", "n_copies", F.array_join(shown, "").alias("text"),
    )
