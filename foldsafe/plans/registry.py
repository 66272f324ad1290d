"""The list of queries and helpers to write their check SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsafe.sources import derived

Build = Callable[[SparkSession, str], DataFrame]
SEED = 42
FOLDS = 5


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a job under a name, with the SQL that checks it where SQL can."""

    def keep(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return keep


def with_tables(*names: str, then: str, extra: str = "") -> str:
    """SQL with the derived tables it reads as leading common table expressions."""
    tables = derived.sql_tables()
    parts = [tables[n] for n in names] + ([extra.strip()] if extra else [])
    return "WITH " + ",\n".join(parts) + "\n" + then.strip()


def _nudge(places: int) -> float:
    """Moves exact ties (means of cents end in 5) off the edge, where engines may differ."""
    return 10.0 ** -(places + 3)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Round the named doubles, with no negative zero, as `sql_round` does."""
    made: dict[str, Column] = {
        c: F.round(F.col(c) + F.lit(_nudge(places)), places) + F.lit(0.0) for c in columns
    }
    return df.withColumns(made)


def sql_round(expression: str, places: int = 6) -> str:
    return f"round({expression} + CAST({_nudge(places)!r} AS DOUBLE), {places}) + 0.0"


# Stratified folds of the passengers by plain ranking: the check engine's version of the splitter.
FOLDED = f"""
ordered AS (
  SELECT p.*, md5(CAST(row_id AS STRING) || '|{SEED}') AS h FROM passengers p
),
placed AS (
  SELECT o.*, row_number() OVER (ORDER BY target, h, row_id) - 1 AS overall,
         row_number() OVER (PARTITION BY target ORDER BY h, row_id) - 1 AS inside
  FROM ordered o
),
shares AS (
  SELECT target AS share_target, overall % {FOLDS} AS share_fold, count(*) AS n
  FROM placed GROUP BY 1, 2
),
ranges AS (
  SELECT share_target, share_fold, n,
         sum(n) OVER (PARTITION BY share_target ORDER BY share_fold) AS until
  FROM shares
),
folded AS (
  SELECT p.* EXCLUDE (h, overall, inside), CAST(share_fold AS INT) AS fold
  FROM placed p JOIN ranges r
    ON p.target = r.share_target AND p.inside >= r.until - r.n AND p.inside < r.until
)
"""
HOLDOUTS = f"holdouts AS (SELECT CAST(range AS INT) AS holdout FROM range({FOLDS}))"
