"""Cross-fitted models on whole tables.

SQL cannot train them. Its part is to recount what every run must keep (rows, distinct ids and labels of
each fold); the job's part is to prove its scores: each boolean is computed from the real scores by a
second way (Spark's own evaluators, models applied one by one, thresholds counted again) and must be
true. Tests compare coefficients with closed forms.

`oof_logistic_documents` learns from length, language and source of the documents, not from their text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsafe.config import CVConfig, FeaturesConfig, ModelSpec
from foldsafe.functions.numeric import over_threshold
from foldsafe.operators import ensemble, metrics, models, preprocess, scoring, thresholds, training
from foldsafe.operators.small import table
from foldsafe.plans.feature_queries import _MEDIAN, CONFIG, _stats_cte, folded
from foldsafe.plans.registry import FOLDED, FOLDS, SEED, query, rounded, sql_round, with_tables
from foldsafe.sources import derived, scratch

_INPUTS = ["row_id", "target", "pclass", "sex", "age", "sibsp", "parch", "fare", "embarked"]
_PLAIN = FeaturesConfig(
    add_family=True, add_is_alone=True, log_fare=True, columns=derived.PASSENGER_COLUMNS
)
_CV = CVConfig(scheme="stratified", n_splits=FOLDS)
_LOGISTIC = ModelSpec("logistic", {"C": 1.0})
_CLOSE = 1e-9


def _plain_passengers(spark, sf) -> DataFrame:
    return scratch.dealt(derived.passengers(spark, sf).select(*_INPUTS), "passengers")


def _fit(df: DataFrame, cv: CVConfig, features: FeaturesConfig, *specs: ModelSpec, **extra):
    return training.cross_fit(
        df,
        cv,
        features,
        specs,
        **{
            "id_col": "row_id",
            "target": "target",
            "parallelism": cv.n_splits,
            **extra,
        },
    )


def _same(a, b):
    return F.abs(a - b) < _CLOSE


def _by_fold(run: training.Run) -> DataFrame:
    """Rows, distinct ids and the sum of labels per fold; whether Spark's evaluator gives the same score."""
    oof = run.oof
    binary = run.task == "binary"
    if binary:
        judge = BinaryClassificationEvaluator(rawPredictionCol="oof", labelCol=models.LABEL, numBins=0)
    else:
        judge = RegressionEvaluator(predictionCol="oof", labelCol=models.LABEL, metricName="rmse")
    facts = []
    for name, scores in run.scores.items():
        for fold, score in enumerate(scores):
            again = judge.evaluate(oof.filter((F.col("model") == name) & (F.col("fold") == fold)))
            facts.append((name, fold, score is not None and abs(again - score) < 1e-6))
    proved = table(oof.sparkSession, "model string, fold int, score_agrees boolean", facts)
    valid = F.col("oof").between(0, 1) if binary else ~F.isnan("oof")
    counted = oof.groupBy("model", "fold").agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(run.id_col).alias("ids"),
        F.sum(models.LABEL).alias("labels"),
        F.bool_and(valid).alias("scores_valid"),
    )
    found = counted.join(proved, ["model", "fold"]).withColumn("fold", F.col("fold").cast("int"))
    return rounded(found, "labels", places=3)


def _recount(model: str, source: str = "folded") -> str:
    return f"""SELECT '{model}' AS model, fold, count(*) AS rows, count(DISTINCT row_id) AS ids,
        {sql_round("sum(CAST(target AS DOUBLE))", 3)} AS labels, TRUE AS scores_valid, TRUE AS score_agrees
        FROM {source} GROUP BY fold"""


@query("oof_logistic", with_tables("passengers", extra=FOLDED, then=_recount("logistic")))
def oof_logistic(spark, sf):
    """All engineered features; names, tickets and cabins themselves are left out."""
    df = scratch.dealt(derived.passengers(spark, sf).drop("group_key", "event_time", "score"), "passengers")
    features = FeaturesConfig.from_flags(
        CONFIG.flags(), columns=CONFIG.columns, drop_cols=("full_name", "ticket", "cabin")
    )
    return _by_fold(_fit(df, _CV, features, _LOGISTIC))


_DOCUMENTS_SQL = f"""WITH passengers AS (
  SELECT doc_id AS row_id, quality AS target FROM labels JOIN documents USING (doc_id)),
{FOLDED.strip()}
{_recount("logistic")}"""


@query("oof_logistic_documents", _DOCUMENTS_SQL)
def oof_logistic_documents(spark, sf):
    """Uses `n_chars`, `lang` and `source` of every labelled document."""
    df = derived.documents(spark, sf).drop("toxic")
    run = _fit(df, _CV, FeaturesConfig(), _LOGISTIC, id_col="doc_id", target="quality")
    return _by_fold(run)


_BLOCKS = f"""blocks AS (
  SELECT row_id, score AS target, CAST(CASE WHEN place < n - {FOLDS} * (n // {FOLDS + 1}) THEN -1
    ELSE (place - (n - {FOLDS} * (n // {FOLDS + 1}))) // (n // {FOLDS + 1}) END AS INT) AS fold
  FROM (SELECT row_id, score, count(*) OVER () AS n, row_number() OVER (
    ORDER BY event_time, md5(CAST(row_id AS STRING) || '|{SEED}'), row_id) - 1 AS place FROM passengers))"""


@query("oof_ridge", with_tables("passengers", extra=_BLOCKS, then=_recount("ridge", "blocks").replace("GROUP BY", "WHERE fold >= 0 GROUP BY")))
def oof_ridge(spark, sf):
    """Regression of the score with folds in time order."""
    df = derived.passengers(spark, sf).select(*_INPUTS, "event_time", "score").drop("target")
    cv = CVConfig(scheme="timeseries", n_splits=FOLDS, time_column="event_time")
    features = FeaturesConfig(
        log_fare=True, columns=derived.PASSENGER_COLUMNS, drop_cols=("event_time",)
    )
    return _by_fold(_fit(df, cv, features, ModelSpec("ridge"), target="score", task="regression"))


# Boosting rounds run one after another, a job per level for all folds. `hgb` has its own defaults (100 rounds), `rf`
# its depth; the others, whose defaults are 200 to 800, have fewer rounds or trees (figures in the README). Folds, rows,
# depth, rates and penalties are always the defaults. Blank numbers reach `hgb`, `xgb` and `catboost` as blanks.
_TREES = {
    "rf": {"n_estimators": 20},
    "gbc": {"n_estimators": 40},
    "hgb": {},
    "xgb": {"n_estimators": 40},
    "catboost": {"iterations": 40},
}
_SECOND = ModelSpec("gbc", {"n_estimators": 20})


def _register_trees(name: str) -> None:
    @query(f"oof_{name}", with_tables("passengers", extra=FOLDED, then=_recount(name)))
    def trees(spark, sf):
        spec = ModelSpec(name, _TREES[name])
        return _by_fold(_fit(_plain_passengers(spark, sf), _CV, _PLAIN, spec))


for _name in _TREES:
    _register_trees(_name)


@query(
    "model_compare",
    with_tables(
        "passengers",
        extra=FOLDED,
        then="""SELECT model, count(DISTINCT fold) AS folds, count(*) AS rows, TRUE AS mean_agrees, TRUE AS choice_agrees
        FROM folded, (VALUES ('logistic'), ('gbc')) AS m(model) GROUP BY model""",
    ),
)
def model_compare(spark, sf):
    """Two models on the same folds; the run keeps the better one."""
    run = _fit(_plain_passengers(spark, sf), _CV, _PLAIN, _LOGISTIC, _SECOND)
    judge = BinaryClassificationEvaluator(rawPredictionCol="oof", labelCol=models.LABEL, numBins=0)
    again = {
        name: sum(
            judge.evaluate(run.oof.filter((F.col("model") == name) & (F.col("fold") == f))) for f in range(FOLDS)
        ) / FOLDS
        for name in run.scores
    }
    means = F.create_map(*[F.lit(x) for pair in again.items() for x in pair])
    rows = run.oof.groupBy("model").agg(F.countDistinct("fold").alias("folds"), F.count(F.lit(1)).alias("rows"))
    found = metrics.fold_summary(run.score_table()).join(rows, "model")
    best = max(again, key=again.get)
    return found.select(
        "model", "folds", "rows",
        (F.abs(F.col("score_mean") - means[F.col("model")]) < 1e-6).alias("mean_agrees"),
        F.lit(run.best == best).alias("choice_agrees"),
    )


def _one_by_one(fold_models, df: DataFrame) -> DataFrame:
    """The mean score per row from each model applied alone, put together by id."""
    parts = [
        model.transform(df).select("row_id", F.get(vector_to_array("probability"), F.lit(1)).alias("alone"))
        for model in fold_models
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("row_id").agg(F.avg("alone").alias("alone"))


_EVERY_ROW = with_tables("passengers", then="SELECT row_id, TRUE AS agrees, TRUE AS cut_agrees FROM passengers")


@query("score_folds", _EVERY_ROW)
def score_folds(spark, sf):
    """Every fold model scores the whole table; the mean is cut at one half."""
    df = _plain_passengers(spark, sf)
    run = _fit(df, _CV, _PLAIN, _LOGISTIC)
    inputs = df.drop("target")
    scored = scoring.fold_average(run.fold_models, inputs).select("row_id", "p")
    labels = scoring.predict(run.fold_models, inputs, "row_id", "label", 0.5)
    both = scored.join(labels, "row_id").join(_one_by_one(run.fold_models, inputs), "row_id")
    at_edge = _same(F.col("alone"), F.lit(0.5))
    cut = ((F.col("alone") >= 0.5).cast("int") == F.col("label")) | at_edge
    return both.select("row_id", _same(F.col("p"), F.col("alone")).alias("agrees"), cut.alias("cut_agrees"))


@query("score_best", _EVERY_ROW)
def score_best(spark, sf):
    """The best model fitted on all rows; its labels are its scores cut above one half."""
    df = _plain_passengers(spark, sf)
    run = _fit(df, _CV, _PLAIN, _LOGISTIC)
    whole = training.refit(run, df)
    labels = scoring.predict_best(whole, df.drop("target"), "row_id", "label")
    both = labels.join(_one_by_one([whole], df.drop("target")), "row_id")
    cut = ((F.col("alone") > 0.5).cast("int") == F.col("label")) | _same(F.col("alone"), F.lit(0.5))
    return both.select("row_id", F.col("alone").between(0, 1).alias("agrees"), cut.alias("cut_agrees"))


@query("score_saved", _EVERY_ROW)
def score_saved(spark, sf):
    """Fold models saved twice, found again as the latest run, and used: the same scores, the rows once."""
    df = _plain_passengers(spark, sf)
    path = scratch.new_path(spark, "runs")
    run = _fit(df, _CV, _PLAIN, _LOGISTIC, run_id="20240101-000000")
    run.save(path)
    run.save(path)
    loaded = training.load_fold_models(spark, path)
    inputs = df.drop("target")
    scored = scoring.fold_average(loaded, inputs).select("row_id", "p")
    fresh = scoring.fold_average(run.fold_models, inputs).select("row_id", F.col("p").alias("alone"))
    kept = training.run_tables.read_oof(spark, f"{path}/oof").groupBy("row_id").agg(F.count(F.lit(1)).alias("n"))
    both = scored.join(fresh, "row_id").join(kept, "row_id")
    return both.select("row_id", _same(F.col("p"), F.col("alone")).alias("agrees"), (F.col("n") == 1).alias("cut_agrees"))


@query("ensemble_runs", _EVERY_ROW)
def ensemble_runs(spark, sf):
    """Two runs scored, averaged and cut so that the ones match the training prevalence."""
    df = _plain_passengers(spark, sf)
    both_runs = [
        _fit(df, _CV, _PLAIN, _LOGISTIC, run_id="first"),
        _fit(df, _CV, _PLAIN, _SECOND, run_id="second"),
    ]
    oof = reduce(DataFrame.unionByName, [r.best_oof() for r in both_runs])
    labels = derived.order_labels(spark, sf)
    means = ensemble.mean_oof(oof, labels, "row_id", "target")
    cut = thresholds.prevalence_cut(means, "p", labels, "target").threshold
    # The cut is right if at least as many means reach it as there are ones, and fewer lie above it.
    ones, reach, above = means.agg(F.sum("target"), F.count_if(F.col("p") >= cut), F.count_if(F.col("p") > cut)).first()
    inputs = df.drop("target")
    averaged = scoring.run_average({r.run_id: r.fold_models for r in both_runs}, inputs)
    found = ensemble.submission(averaged, "row_id", cut, "label")
    alone = [_one_by_one(r.fold_models, inputs).withColumnRenamed("alone", r.run_id) for r in both_runs]
    score = (F.col("first") + F.col("second")) / 2
    checked = found.join(alone[0], "row_id").join(alone[1], "row_id")
    agrees = (over_threshold(score, cut) == F.col("label")) | _same(score, F.lit(cut))
    return checked.select("row_id", agrees.alias("agrees"), F.lit(reach >= ones > above).alias("cut_agrees"))


_NUMBERS = ["age", "fare", "parch", "pclass", "sibsp"]
_VECTOR_SQL = f"""{_stats_cte(_MEDIAN)},
levels AS (
  SELECT row_id, fold, 'embarked' AS c, embarked AS level FROM folded
  UNION ALL SELECT row_id, fold, 'sex', sex FROM folded),
seen AS (SELECT holdout, c, level, count(*) AS n FROM levels JOIN holdouts ON fold <> holdout
  WHERE level IS NOT NULL GROUP BY 1, 2, 3),
fill_levels AS (SELECT holdout, c, level FROM (
  SELECT *, row_number() OVER (PARTITION BY holdout, c ORDER BY n DESC, level) AS place FROM seen) WHERE place = 1),
hots AS (
  SELECT l.row_id, CAST(count(s.n) AS DOUBLE) AS hot FROM levels l
  JOIN fill_levels f ON f.holdout = l.fold AND f.c = l.c
  LEFT JOIN seen s ON s.holdout = l.fold AND s.c = l.c AND s.level = coalesce(l.level, f.level) GROUP BY 1),
sizes AS (SELECT holdout, CAST(count(*) + {len(_NUMBERS)} AS INT) AS slots FROM seen GROUP BY 1),
scaled AS (SELECT row_id, fold, """ + ", ".join(
    sql_round(f"""(coalesce({c}, max(fill) FILTER (WHERE "column" = '{c}'))
    - max(mean) FILTER (WHERE "column" = '{c}')) / max(sd) FILTER (WHERE "column" = '{c}')""")
    + f" AS {c}"
    for c in _NUMBERS
) + f" FROM folded JOIN stats ON holdout = fold GROUP BY row_id, fold, {', '.join(_NUMBERS)})"


@query(
    "feature_vector",
    with_tables(
        "passengers",
        extra=_VECTOR_SQL,
        then="""SELECT s.row_id, fold, age, fare, parch, pclass, sibsp, hot, slots
        FROM scaled s JOIN hots USING (row_id) JOIN sizes ON holdout = fold""",
    ),
)
def feature_vector(spark, sf):
    """The assembled vector of every row under its own fold's pipeline."""
    rows = folded(spark, sf, *_NUMBERS, "embarked", "sex").drop("target")
    preps = preprocess.learn(rows, FeaturesConfig(), FOLDS, "stratified", ["row_id"])
    parts = []
    for fold, prep in enumerate(preps):
        vector = vector_to_array("features")
        parts.append(
            prep.transform(rows.filter(F.col("fold") == fold)).select(
                "row_id",
                "fold",
                *[F.get(vector, F.lit(i)).alias(c) for i, c in enumerate(_NUMBERS)],
                F.aggregate(
                    F.slice(vector, len(_NUMBERS) + 1, F.size(vector)), F.lit(0.0), lambda a, b: a + b
                ).alias("hot"),
                F.size(vector).alias("slots"),
            )
        )
    return rounded(reduce(DataFrame.unionByName, parts), *_NUMBERS)
