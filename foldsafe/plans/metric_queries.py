"""Metrics, thresholds and ensembles on deterministic scores, with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldsafe.functions import numeric
from foldsafe.operators import ensemble, metrics, thresholds
from foldsafe.plans.registry import query, rounded, sql_round, with_tables
from foldsafe.sources import derived
from foldsafe.sources.tables import load


@query(
    "apply_threshold",
    with_tables(
        "passengers",
        then="SELECT row_id, score, CAST(score >= CAST(0.6 AS DOUBLE) AS INT) AS label FROM passengers",
    ),
)
def apply_threshold(spark, sf):
    df = derived.passengers(spark, sf).select("row_id", "score")
    return thresholds.apply(df, "score", 0.6)


@query(
    "sigmoid_score",
    with_tables(
        "scores", then=f"SELECT row_id, {sql_round('1 / (1 + exp(-(a - b) * 4))')} AS p FROM scores"
    ),
)
def sigmoid_score(spark, sf):
    decision = (F.col("a") - F.col("b")) * 4
    return rounded(
        derived.scores(spark, sf).select("row_id", numeric.sigmoid(decision).alias("p")), "p"
    )


@query(
    "oof_label_join",
    with_tables(
        "run_oof",
        "passengers",
        then="""SELECT run_id, row_id, oof, target FROM run_oof JOIN passengers USING (row_id)""",
    ),
)
def oof_label_join(spark, sf):
    return metrics.align(
        derived.run_oof(spark, sf), derived.order_labels(spark, sf), "row_id", "target"
    ).select("run_id", "row_id", "oof", "target")


@query(
    "oof_label_drift",
    """SELECT (SELECT count(*) FROM documents) AS oof_rows,
    (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS joined_rows""",
)
def oof_label_drift(spark, sf):
    """Labels cover only some of the scored documents."""
    scored = load(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("oof"))
    return metrics.alignment_drift(scored, load(spark, sf, "labels"), "doc_id", "quality")


@query(
    "metric_rmse",
    with_tables(
        "scores",
        "long_scores",
        then=f"""SELECT source, fold, {sql_round('sqrt(avg((target - p) * (target - p)))')} AS rmse
        FROM long_scores GROUP BY source, fold""",
    ),
)
def metric_rmse(spark, sf):
    return rounded(metrics.rmse(derived.long_scores(spark, sf), "target", "p", ["source", "fold"]), "rmse")


# Mean rank of the positives, tied scores sharing the middle rank.
_AUC = """ranked AS (
  SELECT source, fold, target,
    rank() OVER (PARTITION BY source, fold ORDER BY p)
      + (count(*) OVER (PARTITION BY source, fold, p) - 1) / 2 AS place
  FROM long_scores),
areas AS (
  SELECT source, fold,
    (sum(place) FILTER (WHERE target = 1) - sum(target) * (sum(target) + 1) / 2)
      / (sum(target) * (count(*) - sum(target))) AS auc
  FROM ranked GROUP BY source, fold)"""


@query(
    "metric_auc",
    with_tables(
        "scores", "long_scores", extra=_AUC, then=f"SELECT source, fold, {sql_round('auc')} AS auc FROM areas"
    ),
)
def metric_auc(spark, sf):
    return rounded(metrics.auc(derived.long_scores(spark, sf), "target", "p", ["source", "fold"]), "auc")


@query(
    "eval_oof",
    with_tables(
        "run_oof",
        "passengers",
        then=f"""SELECT run_id, 'accuracy' AS metric,
        {sql_round('avg(CAST(CAST(oof >= 0.5 AS INT) = target AS INT))')} AS value, count(*) AS n
        FROM run_oof JOIN passengers USING (row_id) GROUP BY run_id""",
    ),
)
def eval_oof(spark, sf):
    found = metrics.evaluate_oof(
        derived.run_oof(spark, sf), derived.order_labels(spark, sf), "row_id", "target"
    )
    return rounded(found, "value")


def _fold_scores(spark, sf):
    found = metrics.auc(derived.long_scores(spark, sf), "target", "p", ["source", "fold"])
    return found.select(F.col("source").alias("model"), "fold", F.col("auc").alias("score"))


@query(
    "cv_summary",
    with_tables(
        "scores",
        "long_scores",
        extra=_AUC,
        then=f"""SELECT source AS model, CAST(count(*) AS INT) AS folds,
        {sql_round('max_by(auc, fold)')} AS last_score, {sql_round('avg(auc)')} AS score_mean,
        {sql_round('stddev_pop(auc)')} AS score_std FROM areas GROUP BY source""",
    ),
)
def cv_summary(spark, sf):
    found = metrics.fold_summary(_fold_scores(spark, sf)).select(
        "model",
        F.size("fold_scores").alias("folds"),
        F.get("fold_scores", F.size("fold_scores") - 1).alias("last_score"),
        "score_mean",
        "score_std",
    )
    return rounded(found, "last_score", "score_mean", "score_std")


@query(
    "model_selection",
    with_tables(
        "scores",
        "long_scores",
        extra=_AUC,
        then=f"""SELECT source AS model, {sql_round('avg(auc)')} AS score_mean FROM areas
        GROUP BY source ORDER BY avg(auc) DESC, source LIMIT 1""",
    ),
)
def model_selection(spark, sf):
    summary = metrics.fold_summary(_fold_scores(spark, sf))
    best = metrics.best_model(summary, metrics.Direction.MAXIMIZE)
    return rounded(best.select("model", "score_mean"), "score_mean")


_SWEEP = """grid AS (
  SELECT CAST(range AS INT) AS place, CAST(0 AS DOUBLE) + range * CAST(0.01 AS DOUBLE) AS threshold
  FROM range(101)),
swept AS (
  SELECT place, threshold, avg(CAST(CAST(score >= threshold AS INT) = target AS INT)) AS accuracy
  FROM passengers, grid GROUP BY place, threshold)"""


@query(
    "threshold_sweep",
    with_tables(
        "passengers",
        extra=_SWEEP,
        then=f"SELECT place, {sql_round('threshold')} AS threshold, {sql_round('accuracy')} AS accuracy FROM swept",
    ),
)
def threshold_sweep(spark, sf):
    found = thresholds.sweep(derived.passengers(spark, sf), "target", "score")
    return rounded(found, "threshold", "accuracy")


@query(
    "best_threshold",
    with_tables(
        "passengers",
        extra=_SWEEP,
        then=f"""SELECT {sql_round('threshold')} AS best_threshold, {sql_round('accuracy')} AS accuracy
        FROM swept ORDER BY swept.accuracy DESC, swept.threshold LIMIT 1""",
    ),
)
def best_threshold(spark, sf):
    found = thresholds.best(thresholds.sweep(derived.passengers(spark, sf), "target", "score"))
    return rounded(found, "best_threshold", "accuracy")


@query(
    "ensemble_mean",
    with_tables(
        "scores", then=f"SELECT row_id, {sql_round('(a + b + c + d) / 4')} AS p FROM scores"
    ),
)
def ensemble_mean(spark, sf):
    return rounded(ensemble.mean(derived.long_scores(spark, sf), "row_id"), "p")


@query(
    "ensemble_weighted",
    with_tables(
        "scores", then=f"SELECT row_id, {sql_round('(a + 2 * b + c + 4 * d) / 8')} AS p FROM scores"
    ),
)
def ensemble_weighted(spark, sf):
    weights = {"a": 1.0, "b": 2.0, "c": 1.0, "d": 4.0}
    return rounded(ensemble.weighted(derived.long_scores(spark, sf), weights, "row_id"), "p")


@query(
    "vote_ensemble",
    with_tables(
        "scores",
        then="""SELECT row_id, CAST(CAST(a >= 0.5 AS INT) + CAST(b >= 0.5 AS INT) + CAST(c >= 0.5 AS INT)
        + CAST(d >= 0.5 AS INT) >= 2 AS INT) AS label FROM scores""",
    ),
)
def vote_ensemble(spark, sf):
    labels = thresholds.apply(derived.long_scores(spark, sf), "p", 0.5)
    return ensemble.vote(labels, "row_id", "label")


@query(
    "ensemble_oof",
    with_tables(
        "scores",
        "passengers",
        then=f"""SELECT row_id, {sql_round('(a + b + c + d) / 4')} AS p, p.target
        FROM scores s JOIN passengers p USING (row_id)""",
    ),
)
def ensemble_oof(spark, sf):
    oof = derived.long_scores(spark, sf).withColumnRenamed("p", "oof")
    found = ensemble.mean_oof(oof, derived.order_labels(spark, sf), "row_id", "target")
    return rounded(found, "p").select("row_id", "p", "target")


_CUT = """means AS (SELECT row_id, target, (a + b + c + d) / 4 AS p FROM scores),
counted AS (SELECT count(*) AS n, avg(target) AS prevalence,
  CAST(round_even(count(*) * avg(target), 0) AS BIGINT) AS k FROM means),
falling AS (SELECT p, row_number() OVER (ORDER BY p DESC) AS place FROM means)"""


def _cut(spark, sf):
    labels = derived.order_labels(spark, sf)
    oof = derived.long_scores(spark, sf).withColumnRenamed("p", "oof")
    means = ensemble.mean_oof(oof, labels, "row_id", "target")
    return thresholds.prevalence_cut(means, "p", labels, "target")


@query(
    "prevalence_threshold",
    with_tables(
        "scores",
        extra=_CUT,
        then=f"""SELECT n, {sql_round('prevalence')} AS prevalence, k, {sql_round('p')} AS threshold
        FROM counted JOIN falling ON place = k""",
    ),
)
def prevalence_threshold(spark, sf):
    return rounded(_cut(spark, sf).table(spark), "prevalence", "threshold")


@query(
    "ensemble_submit",
    with_tables(
        "scores",
        extra=_CUT,
        then="""SELECT row_id, CAST(means.p >= falling.p AS INT) AS target
        FROM means, counted, falling WHERE place = k""",
    ),
)
def ensemble_submit(spark, sf):
    means = ensemble.mean(derived.long_scores(spark, sf), "row_id")
    return ensemble.submission(means, "row_id", _cut(spark, sf).threshold, "target")
