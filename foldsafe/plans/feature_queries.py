"""Stateless and fold-safe features and their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldsafe.config import FeaturesConfig
from foldsafe.functions import numeric, text
from foldsafe.operators import features, loo, splits, target_encoding
from foldsafe.plans.profile_queries import _DECK_SQL, _FAMILY_SQL, _TITLE_SQL
from foldsafe.plans.registry import FOLDED, FOLDS, HOLDOUTS, SEED, query, rounded, sql_round, with_tables
from foldsafe.sources import derived
from foldsafe.sources.scratch import written

# Some titles are this seldom in the small tables, so the merge into Rare is exercised.
_RARE_BELOW = 50
CONFIG = FeaturesConfig(
    add_family=True,
    add_is_alone=True,
    add_title=True,
    add_deck=True,
    add_ticket_group_size=True,
    log_fare=True,
    bin_age=True,
    rare_title_threshold=_RARE_BELOW,
    columns=derived.PASSENGER_COLUMNS,
)
_NUMBERS = ["age", "fare", "parch", "pclass", "sibsp"]
_TEXTS = ["embarked", "sex"]


def folded(spark, sf, *columns):
    """Passengers with folds, assigned once and stored: what is learnt reads them several times."""
    rows = derived.passengers(spark, sf)
    if columns:
        rows = rows.select("row_id", "target", *columns)
    assigned = splits.stratified(rows, "row_id", "target", FOLDS, SEED)
    return written(assigned, "folded")


_NORMAL_TITLE = (
    f"CASE {_TITLE_SQL} WHEN 'Mlle' THEN 'Miss' WHEN 'Ms' THEN 'Miss' WHEN 'Mme' THEN 'Mrs' "
    f"ELSE {_TITLE_SQL} END"
)
_ROYAL_TITLE = (
    f"CASE WHEN {_TITLE_SQL} IN ('Mlle', 'Ms') THEN 'Miss' WHEN {_TITLE_SQL} = 'Mme' THEN 'Mrs' "
    f"WHEN {_TITLE_SQL} IN ('Lady', 'Countess', 'Dona', 'Sir', 'Don') THEN 'Royal' "
    f"WHEN {_TITLE_SQL} IN ('Jonkheer', 'Capt', 'Col', 'Dr', 'Major', 'Rev') THEN 'Rare' "
    f"ELSE {_TITLE_SQL} END"
)
_AGE_BIN = (
    "CASE "
    + " ".join(
        f"WHEN age > {lo} AND age <= {hi} THEN '({lo}, {hi}]'"
        for lo, hi in zip(numeric.AGE_EDGES, numeric.AGE_EDGES[1:])
    )
    + " ELSE 'nan' END"
)


@query(
    "title_extract",
    with_tables("passengers", then=f"SELECT row_id, {_NORMAL_TITLE} AS title FROM passengers"),
)
def title_extract(spark, sf):
    return derived.passengers(spark, sf).select(
        "row_id", text.normal_title(F.col("full_name")).alias("title")
    )


@query(
    "title_royal",
    with_tables("passengers", then=f"SELECT row_id, {_ROYAL_TITLE} AS title FROM passengers"),
)
def title_royal(spark, sf):
    return derived.passengers(spark, sf).select(
        "row_id", text.grouped_title(F.col("full_name")).alias("title")
    )


@query(
    "family_features",
    with_tables(
        "passengers",
        then=f"""SELECT row_id, {_FAMILY_SQL} AS family_size,
        CAST({_FAMILY_SQL} = 1 AS INT) AS is_alone FROM passengers""",
    ),
)
def family_features(spark, sf):
    size = numeric.family_size(F.col("sibsp"), F.col("parch"))
    return derived.passengers(spark, sf).select(
        "row_id", size.alias("family_size"), numeric.is_alone(size).alias("is_alone")
    )


@query(
    "deck_feature",
    with_tables("passengers", then=f"SELECT row_id, {_DECK_SQL} AS deck FROM passengers"),
)
def deck_feature(spark, sf):
    return derived.passengers(spark, sf).select("row_id", text.deck(F.col("cabin")).alias("deck"))


@query(
    "log_fare",
    with_tables("passengers", then=f"SELECT row_id, {sql_round('ln(1 + fare)')} AS log_fare FROM passengers"),
)
def log_fare(spark, sf):
    df = derived.passengers(spark, sf)
    return rounded(df.select("row_id", numeric.log_amount(F.col("fare")).alias("log_fare")), "log_fare")


@query(
    "age_bin_feature",
    with_tables("passengers", then=f"SELECT row_id, {_AGE_BIN} AS age_bin FROM passengers"),
)
def age_bin_feature(spark, sf):
    return derived.passengers(spark, sf).select("row_id", numeric.age_bin(F.col("age")).alias("age_bin"))


# What a row of fold f may use: everything outside f.
_SIZES = """sizes AS (
  SELECT f.fold AS holdout, o.ticket, count(*) AS n
  FROM (SELECT DISTINCT fold FROM folded) f JOIN folded o ON o.fold <> f.fold GROUP BY 1, 2)"""
_TITLED = f"titled AS (SELECT f.*, {_NORMAL_TITLE} AS raw_title FROM folded f)"
_TITLES = """titles AS (
  SELECT f.fold AS holdout, o.raw_title, count(*) AS n
  FROM (SELECT DISTINCT fold FROM titled) f JOIN titled o ON o.fold <> f.fold GROUP BY 1, 2)"""


@query(
    "ticket_group_size",
    with_tables(
        "passengers",
        extra=f"{FOLDED}, {_SIZES}",
        then="""SELECT row_id, fold, CAST(coalesce(n, 1) AS INT) AS ticket_group_size
        FROM folded LEFT JOIN sizes ON holdout = fold AND sizes.ticket = folded.ticket""",
    ),
)
def ticket_group_size(spark, sf):
    cfg = FeaturesConfig(add_ticket_group_size=True, columns=derived.PASSENGER_COLUMNS)
    df = features.leave_fold_out(folded(spark, sf, "ticket"), cfg, FOLDS)
    return df.select("row_id", "fold", F.col(features.TICKET_GROUP).alias("ticket_group_size"))


@query(
    "title_rare",
    with_tables(
        "passengers",
        extra=f"{FOLDED}, {_TITLED}, {_TITLES}",
        then=f"""SELECT row_id, fold, CASE WHEN n < {_RARE_BELOW} THEN 'Rare' ELSE t.raw_title END AS title
        FROM titled t LEFT JOIN titles ON holdout = fold AND titles.raw_title = t.raw_title""",
    ),
)
def title_rare(spark, sf):
    cfg = FeaturesConfig(
        add_title=True, rare_title_threshold=_RARE_BELOW, columns=derived.PASSENGER_COLUMNS
    )
    df = features.leave_fold_out(folded(spark, sf, "full_name"), cfg, FOLDS)
    return df.select("row_id", "fold", F.col(features.TITLE).alias("title"))


@query(
    "features_loo",
    with_tables(
        "passengers",
        extra=f"{FOLDED}, {_SIZES}, {_TITLED}, {_TITLES}",
        then=f"""SELECT t.row_id, t.fold, {_FAMILY_SQL} AS family_size,
        CAST({_FAMILY_SQL} = 1 AS INT) AS is_alone,
        CASE WHEN titles.n < {_RARE_BELOW} THEN 'Rare' ELSE t.raw_title END AS title,
        {_DECK_SQL} AS deck, CAST(coalesce(sizes.n, 1) AS INT) AS ticket_group_size,
        {sql_round('ln(1 + fare)')} AS log_fare, {_AGE_BIN} AS age_bin
        FROM titled t
        LEFT JOIN sizes ON sizes.holdout = t.fold AND sizes.ticket = t.ticket
        LEFT JOIN titles ON titles.holdout = t.fold AND titles.raw_title = t.raw_title""",
    ),
)
def features_loo(spark, sf):
    df = features.leave_fold_out(folded(spark, sf), CONFIG, FOLDS).select(
        "row_id",
        "fold",
        F.col(features.FAMILY).alias("family_size"),
        F.col(features.ALONE).alias("is_alone"),
        F.col(features.TITLE).alias("title"),
        F.col(features.DECK).alias("deck"),
        F.col(features.TICKET_GROUP).alias("ticket_group_size"),
        F.col(features.LOG_FARE).alias("log_fare"),
        F.col(features.AGE_BIN).alias("age_bin"),
    )
    return rounded(df, "log_fare")


def _stats_cte(fill: str) -> str:
    """Fill, mean and deviation per holdout and column, by re-reading the training rows."""
    long = " UNION ALL ".join(
        f"""SELECT row_id, fold, '{c}' AS "column", CAST({c} AS DOUBLE) AS x FROM folded""" for c in _NUMBERS
    )
    return f"""{FOLDED}, {HOLDOUTS}, long AS ({long}),
    fills AS (SELECT holdout, "column", {fill} AS fill
      FROM long JOIN holdouts ON fold <> holdout GROUP BY 1, 2),
    filled AS (SELECT f.holdout, l."column", coalesce(x, fill) AS x, x IS NOT NULL AS known, fill
      FROM long l JOIN fills f ON l.fold <> f.holdout AND l."column" = f."column"),
    stats AS (SELECT holdout, "column", count(*) AS rows, CAST(sum(CAST(known AS INT)) AS BIGINT) AS n,
      any_value(fill) AS fill, avg(x) AS mean,
      CASE WHEN max(x) = min(x) THEN 1.0 ELSE stddev_pop(x) END AS sd FROM filled GROUP BY 1, 2)"""


_MEDIAN = "quantile_cont(x, 0.5)"


@query(
    "loo_impute_stats",
    with_tables(
        "passengers",
        extra=_stats_cte(_MEDIAN),
        then=f"""SELECT holdout, "column", rows, n, {sql_round('fill', 4)} AS fill FROM stats""",
    ),
)
def loo_impute_stats(spark, sf):
    df = loo.numeric_stats(folded(spark, sf, *_NUMBERS), _NUMBERS, FOLDS)
    return rounded(df.select("holdout", "column", "rows", "n", "fill"), "fill", places=4)


@query(
    "loo_impute_mean",
    with_tables(
        "passengers",
        extra=_stats_cte("avg(x)"),
        then=f"""SELECT holdout, "column", {sql_round('fill', 4)} AS fill, {sql_round('mean', 4)} AS mean, {sql_round('sd', 4)} AS sd FROM stats""",
    ),
)
def loo_impute_mean(spark, sf):
    df = loo.numeric_stats(folded(spark, sf, *_NUMBERS), _NUMBERS, FOLDS, "mean")
    return rounded(df.select("holdout", "column", "fill", "mean", "sd"), "fill", "mean", "sd", places=4)


@query(
    "loo_impute_mode",
    with_tables(
        "passengers",
        extra=FOLDED
        + f""", {HOLDOUTS}, long AS ({" UNION ALL ".join(
            f'''SELECT fold, '{c}' AS "column", CAST({c} AS VARCHAR) AS level FROM folded WHERE {c} IS NOT NULL'''
            for c in _TEXTS)}),
        counts AS (SELECT holdout, "column", level, count(*) AS n
          FROM long JOIN holdouts ON fold <> holdout GROUP BY 1, 2, 3),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY holdout, "column" ORDER BY n DESC, level) AS place
          FROM counts)""",
        then="""SELECT holdout, "column", level AS fill FROM ranked WHERE place = 1""",
    ),
)
def loo_impute_mode(spark, sf):
    return loo.modes(loo.level_counts(folded(spark, sf, *_TEXTS), _TEXTS, FOLDS, "stratified"))


@query(
    "loo_scale_stats",
    with_tables(
        "passengers",
        extra=_stats_cte(_MEDIAN),
        then=f"""SELECT holdout, "column", {sql_round('mean', 4)} AS mean, {sql_round('sd', 4)} AS sd FROM stats""",
    ),
)
def loo_scale_stats(spark, sf):
    df = loo.numeric_stats(folded(spark, sf, *_NUMBERS), _NUMBERS, FOLDS)
    return rounded(df.select("holdout", "column", "mean", "sd"), "mean", "sd", places=4)


@query(
    "impute_scale_loo",
    with_tables(
        "passengers",
        extra=_stats_cte(_MEDIAN),
        then="SELECT row_id, fold, "
        + ", ".join(
            sql_round(f"""(coalesce({c}, max(fill) FILTER (WHERE "column" = '{c}'))
              - max(mean) FILTER (WHERE "column" = '{c}')) / max(sd) FILTER (WHERE "column" = '{c}')""")
            + f" AS {c}"
            for c in _NUMBERS
        )
        + f" FROM folded JOIN stats ON holdout = fold GROUP BY row_id, fold, {', '.join(_NUMBERS)}",
    ),
)
def impute_scale_loo(spark, sf):
    rows = folded(spark, sf, *_NUMBERS).drop("target")
    stats = loo.numeric_stats(rows, _NUMBERS, FOLDS)
    return rounded(loo.impute_scale(rows, _NUMBERS, stats), *_NUMBERS)


_LEVELS = f"""{FOLDED}, {HOLDOUTS}, long AS ({" UNION ALL ".join(
    f'''SELECT row_id, fold, '{c}' AS "column", CAST({c} AS VARCHAR) AS level FROM folded'''
    for c in [*_TEXTS, "ticket"])}),
counts AS (SELECT holdout, "column", level, count(*) AS n
  FROM long JOIN holdouts ON fold <> holdout WHERE level IS NOT NULL GROUP BY 1, 2, 3)"""


@query(
    "ohe_categories",
    with_tables("passengers", extra=_LEVELS, then='SELECT holdout, "column", level, n FROM counts'),
)
def ohe_categories(spark, sf):
    return loo.level_counts(folded(spark, sf, *_TEXTS, "ticket"), [*_TEXTS, "ticket"], FOLDS, "stratified")


@query(
    "onehot_loo",
    with_tables(
        "passengers",
        extra=_LEVELS
        + """, fills AS (SELECT holdout, "column", level AS fill FROM (
          SELECT *, row_number() OVER (PARTITION BY holdout, "column" ORDER BY n DESC, level) AS place FROM counts)
          WHERE place = 1),
        filled AS (SELECT row_id, fold, l."column", coalesce(level, fill) AS level
          FROM long l LEFT JOIN fills f ON f.holdout = l.fold AND f."column" = l."column")""",
        then="""SELECT row_id, fold, f."column", coalesce(f.level, 'nan') AS level,
        CAST(c.n IS NOT NULL AS INT) AS hot FROM filled f
        LEFT JOIN counts c ON c.holdout = f.fold AND c."column" = f."column" AND c.level = f.level""",
    ),
)
def onehot_loo(spark, sf):
    return loo.one_hot(folded(spark, sf, *_TEXTS, "ticket"), "row_id", [*_TEXTS, "ticket"], FOLDS)


_ENCODED = ["embarked", "ticket"]
_ENCODED_LONG = f"""{FOLDED}, {HOLDOUTS}, long AS ({" UNION ALL ".join(
    f'''SELECT row_id, fold, target, '{c}' AS "column", coalesce(CAST({c} AS VARCHAR), 'nan') AS level FROM folded'''
    for c in _ENCODED)})"""
_SMOOTHING = 20


@query(
    "target_encode_loo",
    with_tables(
        "passengers",
        extra=_ENCODED_LONG
        + """, sums AS (SELECT "column", level, fold AS part, count(*) AS n, sum(target) AS s FROM long GROUP BY 1, 2, 3),
        totals AS (SELECT fold AS part, count(*) AS n, sum(target) AS s FROM folded GROUP BY 1),
        priors AS (SELECT f.fold, holdout, CAST(sum(s) AS DOUBLE) / sum(n) AS prior
          FROM (SELECT DISTINCT fold FROM folded) f, holdouts, totals
          WHERE part <> holdout AND part <> f.fold GROUP BY 1, 2),
        views AS (SELECT l.row_id, l.fold, l."column", holdout, coalesce(sum(n), 0) AS n, coalesce(sum(s), 0) AS s
          FROM long l CROSS JOIN holdouts LEFT JOIN sums o
            ON o."column" = l."column" AND o.level = l.level AND part <> holdout AND part <> l.fold
          GROUP BY 1, 2, 3, 4)""",
        then=f"""SELECT row_id, v.fold, "column", v.holdout,
        {sql_round(f"(CAST(s AS DOUBLE) + {_SMOOTHING} * prior) / (CAST(n AS DOUBLE) + {_SMOOTHING})")} AS encoded
        FROM views v JOIN priors p ON p.fold = v.fold AND p.holdout = v.holdout""",
    ),
)
def target_encode_loo(spark, sf):
    rows = folded(spark, sf, *_ENCODED)
    return rounded(target_encoding.smoothed(rows, "row_id", _ENCODED, "target", FOLDS, smoothing=_SMOOTHING), "encoded")


@query(
    "target_encode_ordered",
    with_tables(
        "passengers",
        extra=_ENCODED_LONG
        + f""", spread AS (SELECT *, md5(CAST(row_id AS VARCHAR) || '|{SEED}') AS h,
          CASE WHEN fold <> holdout THEN target END AS y FROM long CROSS JOIN holdouts),
        runs AS (SELECT *,
          count(y) OVER before AS n_before, sum(y) OVER before AS s_before,
          count(y) OVER (PARTITION BY holdout, "column", level) AS n_all,
          sum(y) OVER (PARTITION BY holdout, "column", level) AS s_all
          FROM spread WINDOW before AS (PARTITION BY holdout, "column", level ORDER BY h, row_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
        then=f"""SELECT row_id, fold, "column", holdout, {sql_round(
            "(CAST(coalesce(CASE WHEN fold = holdout THEN s_all ELSE s_before END, 0) AS DOUBLE) + 0.5) "
            "/ (CAST(CASE WHEN fold = holdout THEN n_all ELSE n_before END AS DOUBLE) + 1)")} AS encoded FROM runs""",
    ),
)
def target_encode_ordered(spark, sf):
    rows = folded(spark, sf, *_ENCODED)
    return rounded(target_encoding.ordered(rows, "row_id", _ENCODED, "target", FOLDS), "encoded")


_CLIPPED = ["age", "fare", "sibsp"]
_LIMITS = f"""{FOLDED}, {HOLDOUTS}, long AS ({" UNION ALL ".join(
    f'''SELECT fold, '{c}' AS "column", CAST({c} AS DOUBLE) AS x FROM folded''' for c in _CLIPPED)}),
limits AS (SELECT holdout, "column", quantile_cont(x, 0.01) AS low, quantile_cont(x, 0.99) AS high
  FROM long JOIN holdouts ON fold <> holdout GROUP BY 1, 2)"""


@query(
    "winsorise_loo",
    with_tables(
        "passengers",
        extra=_LIMITS,
        then="SELECT row_id, fold, "
        + ", ".join(
            sql_round(f"""CASE WHEN {c} < max(low) FILTER (WHERE "column" = '{c}') THEN max(low) FILTER (WHERE "column" = '{c}')
              WHEN {c} > max(high) FILTER (WHERE "column" = '{c}') THEN max(high) FILTER (WHERE "column" = '{c}')
              ELSE CAST({c} AS DOUBLE) END""", 4)
            + f" AS {c}"
            for c in _CLIPPED
        )
        + f" FROM folded JOIN limits ON holdout = fold GROUP BY row_id, fold, {', '.join(_CLIPPED)}",
    ),
)
def winsorise_loo(spark, sf):
    rows = folded(spark, sf, *_CLIPPED).drop("target")
    limits = loo.clip_limits(rows, _CLIPPED, FOLDS)
    return rounded(loo.winsorise(rows, _CLIPPED, limits), *_CLIPPED, places=4)
