"""Fold assignment and ranks with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldsafe.operators import ranks, splits
from foldsafe.plans.registry import FOLDED, FOLDS, SEED, query, with_tables
from foldsafe.sources import derived

_HASH = f"md5(CAST(row_id AS STRING) || '|{SEED}')"


def _blocks_sql(order: str) -> str:
    return with_tables(
        "passengers",
        then=f"""SELECT row_id, CAST(CASE WHEN place < (n % {FOLDS}) * (n // {FOLDS} + 1)
        THEN place // (n // {FOLDS} + 1)
        ELSE n % {FOLDS} + (place - (n % {FOLDS}) * (n // {FOLDS} + 1)) // (n // {FOLDS}) END AS INT) AS fold
        FROM (SELECT row_id, row_number() OVER (ORDER BY {order}) - 1 AS place, count(*) OVER () AS n
        FROM passengers)""",
    )


@query(
    "global_rank",
    with_tables(
        "passengers",
        then=f"""SELECT row_id, target,
        row_number() OVER (ORDER BY target, {_HASH}, row_id) - 1 AS rank FROM passengers""",
    ),
)
def global_rank(spark, sf):
    df = derived.passengers(spark, sf).select("row_id", "target")
    return ranks.global_rank(df, "row_id", SEED, class_col="target")


@query(
    "time_rank",
    with_tables(
        "passengers",
        then=f"""SELECT row_id,
        row_number() OVER (ORDER BY event_time, {_HASH}, row_id) - 1 AS rank FROM passengers""",
    ),
)
def time_rank(spark, sf):
    df = derived.passengers(spark, sf).select("row_id", "event_time")
    return ranks.global_rank(df, "row_id", SEED, order_col="event_time").select("row_id", "rank")


@query(
    "row_id_assign",
    with_tables(
        "passengers",
        then="""SELECT full_name, fare, event_time, row_number() OVER (
        ORDER BY event_time NULLS FIRST, fare NULLS FIRST, full_name NULLS FIRST) - 1 AS row_id
        FROM (SELECT full_name, fare, event_time FROM passengers)""",
    ),
)
def row_id_assign(spark, sf):
    """Ids for a table without any, from the order of its columns."""
    df = derived.passengers(spark, sf).select("full_name", "fare", "event_time")
    return ranks.with_row_id(df, ["event_time", "fare", "full_name"])


_GAPS = "CASE WHEN row_id % 7 = 0 THEN NULL ELSE target END"


@query(
    "global_rank_nulls",
    with_tables(
        "passengers",
        then=f"""SELECT row_id, {_GAPS} AS label,
        row_number() OVER (ORDER BY {_GAPS} NULLS FIRST, {_HASH}, row_id) - 1 AS rank FROM passengers""",
    ),
)
def global_rank_nulls(spark, sf):
    """Rows without a class come first and keep their places."""
    df = derived.passengers(spark, sf).select("row_id", F.expr(_GAPS).alias("label"))
    return ranks.global_rank(df, "row_id", SEED, class_col="label")


_LATE = "CASE WHEN row_id % 9 = 0 THEN NULL ELSE event_time END"


@query(
    "time_rank_nulls",
    with_tables(
        "passengers",
        then=f"""SELECT row_id,
        row_number() OVER (ORDER BY {_LATE} NULLS FIRST, {_HASH}, row_id) - 1 AS rank FROM passengers""",
    ),
)
def time_rank_nulls(spark, sf):
    df = derived.passengers(spark, sf).select("row_id", F.expr(_LATE).alias("moment"))
    return ranks.global_rank(df, "row_id", SEED, order_col="moment").select("row_id", "rank")


@query(
    "stratified_nulls",
    with_tables(
        "passengers",
        extra=f"""placed AS (
          SELECT row_id, {_GAPS} AS label,
            row_number() OVER (ORDER BY {_GAPS} NULLS FIRST, {_HASH}, row_id) - 1 AS overall,
            row_number() OVER (PARTITION BY {_GAPS} ORDER BY {_HASH}, row_id) - 1 AS inside
          FROM passengers),
        shares AS (SELECT label AS l, overall % {FOLDS} AS f, count(*) AS n FROM placed GROUP BY 1, 2),
        ranges AS (SELECT l, f, n, sum(n) OVER (PARTITION BY l ORDER BY f) AS until FROM shares)""",
        then="""SELECT row_id, label, CAST(f AS INT) AS fold FROM placed JOIN ranges
        ON label IS NOT DISTINCT FROM l AND inside >= until - n AND inside < until""",
    ),
)
def stratified_nulls(spark, sf):
    """Rows without a label are dealt out like a class."""
    df = derived.passengers(spark, sf).select("row_id", F.expr(_GAPS).alias("label"))
    return splits.stratified(df, "row_id", "label", FOLDS, SEED)


@query("kfold_assign", _blocks_sql(f"{_HASH}, row_id"))
def kfold_assign(spark, sf):
    df = derived.passengers(spark, sf).select("row_id")
    return splits.kfold(df, "row_id", FOLDS, SEED)


@query("kfold_in_order", _blocks_sql("row_id"))
def kfold_in_order(spark, sf):
    df = derived.passengers(spark, sf).select("row_id")
    return splits.kfold(df, "row_id", FOLDS, SEED, shuffle=False)


@query(
    "stratified_assign",
    with_tables("passengers", extra=FOLDED, then="SELECT row_id, target, fold FROM folded"),
)
def stratified_assign(spark, sf):
    df = derived.passengers(spark, sf).select("row_id", "target")
    return splits.stratified(df, "row_id", "target", FOLDS, SEED)


@query(
    "timeseries_assign",
    with_tables(
        "passengers",
        then=f"""SELECT row_id, CAST(CASE WHEN place < n - {FOLDS} * (n // {FOLDS + 1}) THEN -1
        ELSE (place - (n - {FOLDS} * (n // {FOLDS + 1}))) // (n // {FOLDS + 1}) END AS INT) AS fold
        FROM (SELECT row_id, row_number() OVER (ORDER BY event_time, {_HASH}, row_id) - 1 AS place,
        count(*) OVER () AS n FROM passengers)""",
    ),
)
def timeseries_assign(spark, sf):
    df = derived.passengers(spark, sf).select("row_id", "event_time")
    return splits.timeseries(df, "row_id", "event_time", FOLDS, SEED).select("row_id", "fold")


# Greedy placement: biggest group first, each to the fold that is lightest so far.
_GREEDY = f"""sizes AS (
  SELECT group_key, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, group_key) AS turn
  FROM passengers GROUP BY group_key),
given AS (
  SELECT 0 AS turn, CAST(NULL AS INT) AS group_key, -1 AS fold,
         list_transform(range({FOLDS}), lambda x: CAST(0 AS BIGINT)) AS loads
  UNION ALL
  SELECT s.turn, s.group_key, list_position(g.loads, list_min(g.loads)) - 1,
         list_transform(g.loads, lambda x, i: CASE WHEN i = list_position(g.loads, list_min(g.loads))
           THEN x + s.n ELSE x END)
  FROM given g JOIN sizes s ON s.turn = g.turn + 1)"""


@query(
    "group_assign",
    "WITH RECURSIVE "
    + with_tables(
        "passengers",
        extra=_GREEDY,
        then="""SELECT row_id, p.group_key, CAST(fold AS INT) AS fold
        FROM passengers p JOIN given g ON g.group_key = p.group_key""",
    ).removeprefix("WITH "),
)
def group_assign(spark, sf):
    df = derived.passengers(spark, sf).select("row_id", "group_key")
    return splits.group(df, "group_key", FOLDS, SEED)


# The same with few groups placed one by one, so that most go in by volume.
_PLACED = 2
_BY_VOLUME = f"""counted AS (
  SELECT ticket AS g, count(*) AS n, md5(ticket || '|{SEED}') AS h FROM passengers GROUP BY ticket),
marked AS (SELECT *, n * {_PLACED * FOLDS} >= (SELECT sum(n) FROM counted) AS large FROM counted),
sizes AS (
  SELECT g, n, row_number() OVER (ORDER BY n DESC, g) AS turn FROM marked WHERE large),
given AS (
  SELECT 0 AS turn, CAST(NULL AS VARCHAR) AS g, -1 AS fold,
         list_transform(range({FOLDS}), lambda x: CAST(0 AS BIGINT)) AS loads
  UNION ALL
  SELECT s.turn, s.g, list_position(q.loads, list_min(q.loads)) - 1,
         list_transform(q.loads, lambda x, i: CASE WHEN i = list_position(q.loads, list_min(q.loads))
           THEN x + s.n ELSE x END)
  FROM given q JOIN sizes s ON s.turn = q.turn + 1),
final AS (SELECT unnest(loads) AS load, unnest(range({FOLDS})) AS f
  FROM given WHERE turn = (SELECT max(turn) FROM given)),
volume AS (SELECT coalesce(sum(n), 0) AS v FROM marked WHERE NOT large),
level AS (SELECT min((v + below) / place) AS top FROM (
  SELECT sum(load) OVER (ORDER BY load, f) AS below, row_number() OVER (ORDER BY load, f) AS place, v
  FROM final, volume)),
room AS (SELECT f, sum(greatest(0, top - load)) OVER (ORDER BY f) AS until FROM final, level),
laid AS (SELECT g, sum(n) OVER (ORDER BY h, g) - n AS before FROM marked WHERE NOT large),
folds AS (
  SELECT g, fold FROM given WHERE turn > 0
  UNION ALL
  SELECT g, least({FOLDS - 1}, (SELECT count(*) FROM room WHERE until <= before)) FROM laid)"""


@query(
    "group_assign_volume",
    "WITH RECURSIVE "
    + with_tables(
        "passengers",
        extra=_BY_VOLUME,
        then="""SELECT row_id, ticket, CAST(fold AS INT) AS fold
        FROM passengers JOIN folds ON g = ticket""",
    ).removeprefix("WITH "),
)
def group_assign_volume(spark, sf):
    df = derived.passengers(spark, sf).select("row_id", "ticket")
    return splits.group(df, "ticket", FOLDS, SEED, placed=_PLACED)


@query(
    "fold_balance",
    with_tables(
        "passengers",
        extra=FOLDED,
        then="""SELECT fold, count(*) AS rows, CAST(sum(target) AS BIGINT) AS ones
        FROM folded GROUP BY fold""",
    ),
)
def fold_balance(spark, sf):
    df = derived.passengers(spark, sf).select("row_id", "target")
    folds = splits.stratified(df, "row_id", "target", FOLDS, SEED)
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), F.sum("target").alias("ones"))
