"""Tables derived from the star schema, shaped like the inputs of a tabular competition.

Each projection is plain text that any SQL engine reads the same way, so a check can rebuild the
same table elsewhere. The work of every query grows with orders, lineitem, customer or supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsafe.config import FeatureColumns
from foldsafe.sources.tables import load

PASSENGER_COLUMNS = FeatureColumns(
    siblings="sibsp",
    parents="parch",
    name="full_name",
    cabin="cabin",
    ticket="ticket",
    fare="fare",
    age="age",
)

PASSENGERS = {
    "row_id": "o_orderkey",
    "target": "CAST(o_orderstatus = 'F' AS INT)",
    "pclass": "1 + c_nationkey % 3",
    "sex": "CASE WHEN c_nationkey % 2 = 0 THEN 'female' ELSE 'male' END",
    "full_name": (
        "CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN 'nocomma' "
        "ELSE c_name || ', ' || CASE WHEN o_orderkey % 499 = 0 THEN 'Capt' "
        "WHEN o_orderkey % 101 = 0 THEN 'Mlle' WHEN o_orderkey % 103 = 0 THEN 'Mme' "
        "ELSE c_mktsegment END || '. X' END"
    ),
    "age": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey % 85 AS DOUBLE) END",
    "sibsp": "o_orderkey % 4",
    "parch": "o_custkey % 3",
    "ticket": "'T' || CAST(o_custkey % 500 AS STRING)",
    "fare": "CASE WHEN o_orderkey % 211 = 0 THEN NULL ELSE o_totalprice END",
    "cabin": (
        "CASE WHEN o_orderkey % 4 <> 0 THEN NULL "
        "ELSE c_mktsegment || CAST(o_custkey % 100 AS STRING) END"
    ),
    "embarked": (
        "CASE WHEN o_orderkey % 301 = 0 THEN NULL ELSE SUBSTR(o_orderpriority, 1, 1) END"
    ),
    "group_key": "c_nationkey",
    "event_time": "o_orderdate",
    "score": (
        "CAST(LEAST(1000, (o_orderkey * 7919 + o_custkey * 104729) % 801 "
        "+ CASE WHEN o_orderstatus = 'F' THEN 200 ELSE 0 END) AS DOUBLE) / CAST(1000 AS DOUBLE)"
    ),
}

# One row per submission: every customer is an entry, every supplier a run.
LEDGER = {
    "entry_id": "c_custkey",
    "timestamp": (
        "'2024-' || LPAD(CAST(1 + c_custkey % 12 AS STRING), 2, '0') || '-' "
        "|| LPAD(CAST(1 + c_custkey % 28 AS STRING), 2, '0') || ' 10:00:00'"
    ),
    "competition": "'passengers'",
    "file": "'sub_' || CAST(c_custkey % 700 AS STRING) || '.csv'",
    "message": (
        "CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 6 = 1 THEN '' "
        "WHEN c_custkey % 6 = 2 THEN c_name || REPEAT('-' || c_mktsegment, 12) ELSE c_name END"
    ),
    "run_id": (
        "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 'run-' || "
        "LPAD(CAST(c_custkey % 130 AS STRING), 6, '0') END"
    ),
    "threshold": (
        "CASE WHEN c_custkey % 4 = 0 THEN NULL "
        "ELSE CAST(c_custkey % 97 AS DOUBLE) / CAST(100 AS DOUBLE) END"
    ),
    "oof_accuracy": (
        "CASE WHEN c_custkey % 3 <> 0 THEN NULL "
        "ELSE CAST((c_custkey * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) END"
    ),
    "oof_auc_mean": (
        "CASE WHEN c_custkey % 7 = 0 THEN NULL "
        "ELSE CAST((c_custkey * 31) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) END"
    ),
    "cv_model": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE LOWER(c_mktsegment) END",
    "leaderboard_score": (
        "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal / CAST(10000 AS DOUBLE) END"
    ),
    "features_cfg": (
        "CASE WHEN c_custkey % 8 = 0 THEN '{broken' WHEN c_custkey % 8 = 1 THEN NULL "
        "WHEN c_custkey % 8 = 2 THEN '[1, 2]' "
        "ELSE '{\"log_fare\": true, \"add_title\": false, \"bin_age\": ' "
        "|| CAST(c_nationkey AS STRING) || ', \"scale_numeric\": true}' END"
    ),
    "models_cfg": (
        "CASE WHEN c_custkey % 9 = 0 THEN 'not json' WHEN c_custkey % 9 = 1 THEN '[]' "
        "ELSE '[{\"name\": \"' || LOWER(c_mktsegment) || '\", \"params\": {}}, "
        "{\"name\": \"other\"}]' END"
    ),
    "cv_cfg": (
        "CASE WHEN c_custkey % 7 = 0 THEN '[5]' WHEN c_custkey % 7 = 1 THEN 'n_splits=5' "
        "WHEN c_custkey % 7 = 2 THEN NULL ELSE '{\"n_splits\": 5}' END"
    ),
}

RUNS = {
    "run_id": "'run-' || LPAD(CAST(s_suppkey AS STRING), 6, '0')",
    "model": "CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 'model_' || CAST(s_nationkey AS STRING) END",
    "metric": "CASE WHEN s_suppkey % 2 = 0 THEN 'auc' ELSE 'rmse' END",
    "direction": "CASE WHEN s_suppkey % 2 = 0 THEN 'maximize' ELSE 'minimize' END",
    "score_mean": "s_acctbal / CAST(10000 AS DOUBLE)",
    "score_std": "CAST(s_suppkey % 10 AS DOUBLE) / CAST(100 AS DOUBLE)",
}

OOF_SCORE = (
    "CAST((l_orderkey * 7919 + l_suppkey * 613) % 1001 AS DOUBLE) / CAST(1000 AS DOUBLE)"
)


# Scores of four runs on the orders. Multiples of 1/1024 add up exactly in any order, so averages
# are the same on every engine; ``d`` follows the price, so nearly every row has its own score.
SCORES = {
    "row_id": "o_orderkey",
    "target": "CAST(o_orderstatus = 'F' AS INT)",
    "fold": "CAST(o_custkey % 5 AS INT)",
    "a": (
        "CAST(LEAST(1023, (o_orderkey * 7919 + o_custkey * 104729) % 801 "
        "+ CASE WHEN o_orderstatus = 'F' THEN 200 ELSE 0 END) AS DOUBLE) / CAST(1024 AS DOUBLE)"
    ),
    "b": (
        "CAST(LEAST(1023, (o_orderkey * 613 + o_custkey * 7907) % 901 "
        "+ CASE WHEN o_orderstatus = 'F' THEN 100 ELSE 0 END) AS DOUBLE) / CAST(1024 AS DOUBLE)"
    ),
    "c": "CAST((o_orderkey * 31 + o_custkey * 17) % 1024 AS DOUBLE) / CAST(1024 AS DOUBLE)",
    "d": "CAST(CAST(FLOOR(o_totalprice) AS BIGINT) % 524288 AS DOUBLE) / CAST(524288 AS DOUBLE)",
}
SOURCES = ("a", "b", "c", "d")


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select([F.expr(text).alias(name) for name, text in columns.items()])


def passengers(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order with the customer's attributes; binary target, blanks, tied scores."""
    orders = load(spark, folder, "orders")
    customer = load(spark, folder, "customer")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return _select(joined, PASSENGERS)


def order_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels alone, straight from the orders scan."""
    orders = load(spark, folder, "orders")
    return orders.select(
        F.col("o_orderkey").alias("row_id"), F.expr(PASSENGERS["target"]).alias("target")
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """``(row_id, target, fold, a, b, c, d)``: one column of scores per run."""
    return _select(load(spark, folder, "orders"), SCORES)


def long_scores(spark: SparkSession, folder: str) -> DataFrame:
    """``(row_id, target, fold, source, p)``: one row per order and run."""
    wide = scores(spark, folder)
    return wide.unpivot(["row_id", "target", "fold"], list(SOURCES), "source", "p")


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    return _select(load(spark, folder, "customer"), LEDGER)


def runs(spark: SparkSession, folder: str) -> DataFrame:
    return _select(load(spark, folder, "supplier"), RUNS)


def run_oof(spark: SparkSession, folder: str) -> DataFrame:
    """Out-of-fold rows ``(run_id, row_id, oof)``: a run holds the orders its supplier served."""
    lines = load(spark, folder, "lineitem")
    return lines.select(
        F.expr("'run-' || LPAD(CAST(l_suppkey AS STRING), 6, '0')").alias("run_id"),
        F.col("l_orderkey").alias("row_id"),
        F.expr(OOF_SCORE).alias("oof"),
    ).distinct()


def submissions(spark: SparkSession, folder: str) -> DataFrame:
    """Submitted labels ``(file, row_id, label)``, one file per customer bucket."""
    orders = load(spark, folder, "orders")
    return orders.select(
        F.expr("'sub_' || CAST(o_custkey % 500 AS STRING) || '.csv'").alias("file"),
        F.col("o_orderkey").alias("row_id"),
        F.expr("CAST((o_orderkey * 31) % 3 = 0 AS INT)").alias("label"),
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents: the text's length, language and source with quality and toxic flags."""
    texts = load(spark, folder, "documents").select("doc_id", "n_chars", "lang", "source")
    return load(spark, folder, "labels").join(texts, "doc_id")


def _text_of(name: str, source: str, columns: dict[str, str]) -> str:
    body = ",\n    ".join(f"{text} AS {column}" for column, text in columns.items())
    return f"{name} AS (\n  SELECT {body}\n  FROM {source}\n)"


def sql_tables() -> dict[str, str]:
    """The same tables as common table expressions for a check engine."""
    return {
        "passengers": _text_of(
            "passengers", "orders JOIN customer ON o_custkey = c_custkey", PASSENGERS
        ),
        "ledger": _text_of("ledger", "customer", LEDGER),
        "scores": _text_of("scores", "orders", SCORES),
        "long_scores": (
            "long_scores AS ("
            + " UNION ALL ".join(
                f"SELECT row_id, target, fold, '{s}' AS source, {s} AS p FROM scores" for s in SOURCES
            )
            + ")"
        ),
        "runs": _text_of("runs", "supplier", RUNS),
        "run_oof": (
            "run_oof AS (SELECT DISTINCT 'run-' || LPAD(CAST(l_suppkey AS STRING), 6, '0') AS run_id, "
            f"l_orderkey AS row_id, {OOF_SCORE} AS oof FROM lineitem)"
        ),
        "submissions": (
            "submissions AS (SELECT 'sub_' || CAST(o_custkey % 500 AS STRING) || '.csv' AS file, "
            "o_orderkey AS row_id, CAST((o_orderkey * 31) % 3 = 0 AS INT) AS label FROM orders)"
        ),
    }
