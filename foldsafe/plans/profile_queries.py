"""Profiles of the passengers table and their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldsafe.functions import numeric, text
from foldsafe.operators import contracts, profile, ranks
from foldsafe.plans.registry import query, rounded, sql_round, with_tables
from foldsafe.sources import derived

_NUMBERS = ["row_id", "target", "pclass", "age", "sibsp", "parch", "fare", "group_key", "score"]
_TEXTS = ["sex", "full_name", "ticket", "cabin", "embarked", "event_time"]
_IN_ORDER = list(derived.PASSENGERS)


def _describe_sql() -> str:
    parts = []
    for c in _NUMBERS:
        quarters = ", ".join(
            f"{sql_round(f'quantile_cont(CAST({c} AS DOUBLE), {p})')} AS q{int(p * 100)}" for p in (0.25, 0.5, 0.75)
        )
        parts.append(
            f"""SELECT '{c}' AS "column", count({c}) AS "count", CAST(NULL AS BIGINT) AS "unique",
            CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq,
            {sql_round(f'avg({c})', 4)} AS mean, {sql_round(f'stddev_samp({c})', 4)} AS std,
            {sql_round(f'CAST(min({c}) AS DOUBLE)')} AS "min", {quarters},
            {sql_round(f'CAST(max({c}) AS DOUBLE)')} AS "max" FROM passengers"""
        )
    nothing = ", ".join(
        f'CAST(NULL AS DOUBLE) AS "{c}"' for c in ("mean", "std", "min", "q25", "q50", "q75", "max")
    )
    for c in _TEXTS:
        counts = f"SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n FROM passengers WHERE {c} IS NOT NULL GROUP BY 1"
        parts.append(
            f"""SELECT '{c}' AS "column", (SELECT count({c}) FROM passengers) AS "count",
            (SELECT count(*) FROM ({counts})) AS "unique", value AS top, n AS freq, {nothing}
            FROM (SELECT value, n FROM ({counts}) ORDER BY n DESC, value LIMIT 1)"""
        )
    return with_tables("passengers", then="\nUNION ALL\n".join(parts))


@query("describe_all", _describe_sql())
def describe_all(spark, sf):
    df = profile.describe_all(derived.passengers(spark, sf))
    return rounded(rounded(df, "min", "q25", "q50", "q75", "max"), "mean", "std", places=4)


@query(
    "missingness",
    with_tables(
        "passengers",
        then="SELECT * FROM ("
        + " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing,
            round_even((count(*) - count({c})) / count(*) * 100, 2) AS pct FROM passengers"""
            for c in _IN_ORDER
        )
        + ") WHERE missing > 0",
    ),
)
def missingness(spark, sf):
    return profile.missingness(derived.passengers(spark, sf))


@query(
    "target_distribution",
    with_tables(
        "passengers",
        then="""SELECT target AS value, count(*) AS "count",
        round_even(count(*) / (SELECT count(*) FROM passengers), 3) AS pct
        FROM passengers WHERE target IS NOT NULL GROUP BY target""",
    ),
)
def target_distribution(spark, sf):
    return profile.distribution(derived.passengers(spark, sf), "target")


@query(
    "embarked_distribution",
    with_tables(
        "passengers",
        then="""SELECT embarked AS value, count(*) AS "count",
        round_even(count(*) / (SELECT count(*) FROM passengers), 3) AS pct
        FROM passengers WHERE embarked IS NOT NULL GROUP BY embarked""",
    ),
)
def embarked_distribution(spark, sf):
    return profile.distribution(derived.passengers(spark, sf), "embarked")


def _rate_sql(key: str, name: str = "value", source: str = "passengers") -> str:
    return with_tables(
        "passengers",
        then=f"""SELECT {name}, {sql_round('avg(target)')} AS rate, count(target) AS "count"
        FROM (SELECT {key} AS {name}, target FROM {source}) WHERE {name} IS NOT NULL GROUP BY {name}""",
    )


_TITLE_SQL = """CASE WHEN regexp_matches(coalesce(full_name, 'nan'), ',\\s*([^\\.]+)\\.')
 THEN trim(regexp_extract(coalesce(full_name, 'nan'), ',\\s*([^\\.]+)\\.', 1)) ELSE 'Unknown' END"""
_DECK_SQL = (
    "CASE WHEN substr(cabin, 1, 1) IN ('A','B','C','D','E','F','G','T') "
    "THEN substr(cabin, 1, 1) ELSE 'U' END"
)
_FAMILY_SQL = "CAST(sibsp AS DOUBLE) + CAST(parch AS DOUBLE) + CAST(1 AS DOUBLE)"
_RATES = {
    "sex": (lambda: F.col("sex"), "sex"),
    "pclass": (lambda: F.col("pclass"), "pclass"),
    "embarked": (lambda: F.col("embarked"), "embarked"),
    "title": (
        lambda: text.grouped_title(F.col("full_name")),
        f"CASE {_TITLE_SQL} WHEN 'Mlle' THEN 'Miss' WHEN 'Ms' THEN 'Miss' WHEN 'Mme' THEN 'Mrs' "
        "WHEN 'Capt' THEN 'Rare' ELSE " + _TITLE_SQL + " END",
    ),
    "deck": (lambda: text.deck(F.col("cabin")), _DECK_SQL),
    "family": (lambda: numeric.family_size(F.col("sibsp"), F.col("parch")), _FAMILY_SQL),
    "alone": (
        lambda: numeric.is_alone(numeric.family_size(F.col("sibsp"), F.col("parch"))),
        f"CAST({_FAMILY_SQL} = 1 AS INT)",
    ),
    "ticket": (lambda: F.col("ticket"), "ticket"),
}


def _register_rate(name: str, key, sql: str) -> None:
    @query(f"group_rate_{name}", _rate_sql(sql))
    def rate(spark, sf):
        return rounded(profile.group_rate(derived.passengers(spark, sf), key(), "target"), "rate")


for _name, (_key, _sql) in _RATES.items():
    _register_rate(_name, _key, _sql)


@query(
    "group_rate_ticket_size",
    with_tables(
        "passengers",
        then=f"""SELECT size AS value, {sql_round('avg(target)')} AS rate, count(target) AS "count"
        FROM passengers JOIN (SELECT ticket, count(*) AS size FROM passengers GROUP BY ticket) USING (ticket)
        GROUP BY size""",
    ),
)
def group_rate_ticket_size(spark, sf):
    # Rows of a ticket share its size: rates by size follow from one row per ticket.
    per_ticket = (
        derived.passengers(spark, sf)
        .filter(F.col("ticket").isNotNull())
        .groupBy("ticket")
        .agg(F.count(F.lit(1)).alias("value"), F.sum("target").alias("_ones"), F.count("target").alias("_n"))
    )
    return rounded(
        per_ticket.groupBy("value").agg(
            (F.sum("_ones") / F.sum("_n")).alias("rate"), F.sum("_n").alias("count")
        ),
        "rate",
    )


@query(
    "group_rates_many",
    with_tables(
        "passengers",
        then=" UNION ALL ".join(
            f"""SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, {sql_round('avg(target)')} AS rate,
            count(target) AS "count" FROM passengers WHERE {c} IS NOT NULL GROUP BY {c}"""
            for c in ("sex", "pclass", "embarked", "sibsp")
        ),
    ),
)
def group_rates_many(spark, sf):
    df = derived.passengers(spark, sf)
    return rounded(profile.group_rates(df, ["sex", "pclass", "embarked", "sibsp"], "target"), "rate")


_EDGES = numeric.AGE_EDGES
_BINS_CLOSED = "CASE " + " ".join(
    f"WHEN age {'>=' if i == 0 else '>'} {lo} AND age <= {hi} THEN {i}"
    for i, (lo, hi) in enumerate(zip(_EDGES, _EDGES[1:]))
) + " END"


@query(
    "age_bin_rate",
    with_tables(
        "passengers",
        then=f"""SELECT CAST(place AS INT) AS place, bin, {sql_round('rate')} AS rate
        FROM (VALUES {', '.join(f"({i}, '{b}')" for i, b in enumerate(
            ['(-0.001, 5.0]', '(5.0, 12.0]', '(12.0, 18.0]', '(18.0, 30.0]', '(30.0, 45.0]', '(45.0, 60.0]', '(60.0, 80.0]']
        ))}) AS bins(place, bin)
        LEFT JOIN (SELECT {_BINS_CLOSED} AS b, avg(target) AS rate FROM passengers GROUP BY 1) ON b = place""",
    ),
)
def age_bin_rate(spark, sf):
    return rounded(profile.binned_rate(derived.passengers(spark, sf), "age", "target"), "rate")


@query(
    "pivot_rate",
    with_tables(
        "passengers",
        then=f"""SELECT pclass, {sql_round("avg(CASE WHEN sex = 'female' THEN target END)")} AS female,
        {sql_round("avg(CASE WHEN sex = 'male' THEN target END)")} AS male FROM passengers GROUP BY pclass""",
    ),
)
def pivot_rate(spark, sf):
    df = profile.pivot_rate(derived.passengers(spark, sf), "pclass", "sex", "target", ["female", "male"])
    return rounded(df, "female", "male")


_CORR = ["target", "age", "fare", "sibsp", "parch"]


@query(
    "corr_matrix",
    with_tables(
        "passengers",
        then=" UNION ALL ".join(
            f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
            f"{sql_round(f'corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))')} AS corr FROM passengers"
            for a in _CORR
            for b in _CORR
        ),
    ),
)
def corr_matrix(spark, sf):
    return rounded(profile.correlations(derived.passengers(spark, sf), _CORR), "corr")


@query(
    "prevalence",
    with_tables(
        "passengers",
        then=f"SELECT {sql_round('avg(target)')} AS prevalence, count(target) AS n FROM passengers",
    ),
)
def prevalence(spark, sf):
    return rounded(profile.prevalence(derived.passengers(spark, sf), "target"), "prevalence")


@query(
    "positive_rate",
    with_tables(
        "submissions",
        then=f"SELECT file, {sql_round('avg(CAST(label = 1 AS INT))')} AS pred_pos_rate FROM submissions GROUP BY file",
    ),
)
def positive_rate(spark, sf):
    return rounded(
        profile.positive_rate(derived.submissions(spark, sf), "file", "label"), "pred_pos_rate"
    )


@query(
    "table_shape",
    with_tables(
        "passengers",
        then=" UNION ALL ".join(
            f"""SELECT CAST({i} AS INT) AS place, '{c}' AS "column",
            '{'numeric' if c in _NUMBERS else 'text'}' AS role, CAST({len(_IN_ORDER)} AS INT) AS n_columns,
            count(*) AS n_rows FROM passengers"""
            for i, c in enumerate(_IN_ORDER)
        ),
    ),
)
def table_shape(spark, sf):
    return profile.shape(derived.passengers(spark, sf))


def _role_sql() -> str:
    left_out = ("row_id", "target")
    lists = (("numeric", sorted(set(_NUMBERS) - set(left_out))), ("text", sorted(_TEXTS)))
    return with_tables(
        "passengers",
        then=" UNION ALL ".join(
            f"""SELECT '{c}' AS "column", '{role}' AS role, CAST({i} AS INT) AS place,
            count({c}) AS filled FROM passengers"""
            for role, names in lists
            for i, c in enumerate(names)
        ),
    )


@query("role_split", _role_sql())
def role_split(spark, sf):
    return contracts.role_table(derived.passengers(spark, sf), exclude=["row_id", "target"])


@query(
    "histogram",
    with_tables(
        "passengers",
        extra="""ends AS (SELECT min(fare) AS low, max(fare) AS high, (max(fare) - min(fare)) / 20 AS w
        FROM passengers),
        counts AS (SELECT CAST(least(20, floor((fare - low) / w) + 1) AS INT) AS bin, count(*) AS n
        FROM passengers, ends WHERE fare IS NOT NULL GROUP BY 1)""",
        then=f"""SELECT CAST(r.range AS INT) AS bin, {sql_round('low + (r.range - 1) * w')} AS low,
        {sql_round('low + r.range * w')} AS high, coalesce(n, 0) AS "count"
        FROM range(1, 21) r CROSS JOIN ends LEFT JOIN counts ON counts.bin = r.range""",
    ),
)
def histogram(spark, sf):
    return rounded(profile.histogram(derived.passengers(spark, sf), "fare", 20), "low", "high")


@query(
    "head_rows",
    with_tables(
        "passengers",
        then="""SELECT row_id, target, sex, age,
        CAST(row_number() OVER (ORDER BY row_id) AS INT) AS place FROM passengers ORDER BY row_id LIMIT 5""",
    ),
)
def head_rows(spark, sf):
    df = derived.passengers(spark, sf).select("row_id", "target", "sex", "age")
    return ranks.head(df, ["row_id"], 5)


@query(
    "contract_report",
    with_tables(
        "passengers",
        "run_oof",
        extra="""ids AS (SELECT row_id, count(*) AS a FROM passengers GROUP BY row_id),
        scored AS (SELECT row_id, count(*) AS b FROM run_oof GROUP BY row_id),
        matched AS (SELECT a, b FROM ids FULL JOIN scored USING (row_id))""",
        then="""SELECT finding, rows, (finding IN ('train rows', 'oof rows') OR rows = 0) AS ok FROM (
        SELECT 'train rows' AS finding, (SELECT count(*) FROM passengers) AS rows
        UNION ALL SELECT 'oof rows', (SELECT count(*) FROM run_oof)
        UNION ALL SELECT 'repeated train ids', (SELECT CAST(coalesce(sum(a - 1), 0) AS BIGINT) FROM ids)
        UNION ALL SELECT 'repeated oof ids', (SELECT CAST(coalesce(sum(b - 1), 0) AS BIGINT) FROM scored)
        UNION ALL SELECT 'train ids without oof', (SELECT count(*) FROM matched WHERE b IS NULL)
        UNION ALL SELECT 'oof ids without label', (SELECT count(*) FROM matched WHERE a IS NULL)
        UNION ALL SELECT 'missing targets', (SELECT count(*) FROM passengers WHERE target IS NULL)
        UNION ALL SELECT 'targets not 0 or 1', (SELECT count(*) FROM passengers WHERE target NOT IN (0, 1))
        UNION ALL SELECT 'missing scores', (SELECT count(*) FROM run_oof WHERE oof IS NULL)
        UNION ALL SELECT 'scores outside 0 to 1', (SELECT count(*) FROM run_oof WHERE oof < 0 OR oof > 1))""",
    ),
)
def contract_report(spark, sf):
    return contracts.report(
        derived.passengers(spark, sf), "row_id", "target", derived.run_oof(spark, sf)
    )
