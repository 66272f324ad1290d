"""Readers and writers exercised on derived tables, with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldsafe.functions import snapshot
from foldsafe.plans.registry import query, rounded, sql_round, with_tables
from foldsafe.sources import csv, derived, run_folders, runs, scratch
from foldsafe.sources.tables import load


@query(
    "csv_roundtrip",
    with_tables(
        "passengers",
        then="""SELECT row_id, full_name, age, CASE WHEN sibsp = 3 THEN NULL ELSE CAST(sibsp AS DOUBLE) END AS sibsp,
        CASE WHEN row_id % 3 = 0 THEN NULL ELSE '  say "' || sex || '",' || chr(10) || 'twice ' END AS remark,
        strftime(event_time, '%Y-%m-%d') AS day, fare FROM passengers""",
    ),
)
def csv_roundtrip(spark, sf):
    # Blanks in whole numbers, a blank marker in text, padded text, quotes, commas, line breaks and dates.
    df = derived.passengers(spark, sf).select(
        "row_id",
        "full_name",
        "age",
        F.when(F.col("sibsp") != 3, F.col("sibsp")).alias("sibsp"),
        F.when(F.col("row_id") % 3 == 0, F.lit("NA"))
        .otherwise(F.concat(F.lit('  say "'), F.col("sex"), F.lit('",\ntwice ')))
        .alias("remark"),
        F.date_format("event_time", "yyyy-MM-dd").alias("day"),
        "fare",
    )
    path = scratch.new_path(spark, "csv")
    csv.write(df, path)
    return csv.read(spark, path, multiline=True)


@query(
    "csv_append",
    with_tables(
        "ledger",
        then="""SELECT entry_id, file, CASE WHEN threshold IS NOT NULL THEN cv_model END AS cv_model FROM ledger""",
    ),
)
def csv_append(spark, sf):
    # The older rows lack a column that the newer ones have.
    ledger = derived.ledger(spark, sf)
    old_path, new_path = scratch.new_path(spark, "old"), scratch.new_path(spark, "new")
    csv.write(ledger.filter("threshold IS NULL").select("entry_id", "file"), old_path)
    new = ledger.filter("threshold IS NOT NULL").select("entry_id", "file", "cv_model")
    return csv.append(new, old_path, new_path)


_METRICS = """summaries AS (
  SELECT run_id, model, metric, direction, score_mean, score_std,
    score_mean - score_std AS first_score
  FROM runs WHERE model IS NOT NULL AND CAST(right(run_id, 6) AS INT) % 7 <> 0),
evals AS (
  SELECT run_id, CASE WHEN CAST(right(run_id, 6) AS INT) % 4 = 1 THEN score_std END AS oof_accuracy
  FROM runs WHERE CAST(right(run_id, 6) AS INT) % 2 = 1)"""


def run_metrics(spark, sf):
    """Runs whose summary and evaluation records were written as JSON: some are missing, some broken."""
    known = derived.runs(spark, sf)
    number = F.substring("run_id", 5, 6).cast("int")
    low, high = F.col("score_mean") - F.col("score_std"), F.col("score_mean") + F.col("score_std")
    record = F.to_json(
        F.struct(
            "run_id",
            "model",
            "metric",
            "direction",
            F.array(low, high).alias("fold_scores"),
            "score_mean",
            "score_std",
            F.array(F.lit("fold=0"), F.lit("fold=1")).alias("pipelines"),
        )
    )
    line = F.when(number % 7 == 0, F.lit('{"run_id": broken')).otherwise(record)
    summary_path, eval_path = scratch.new_path(spark, "summary"), scratch.new_path(spark, "eval")
    known.filter(F.col("model").isNotNull()).select(line.alias("value")).write.text(summary_path)
    evals = known.filter(number % 2 == 1).select(
        "run_id",
        F.when(number % 4 == 1, F.lit("accuracy")).otherwise(F.lit("other")).alias("metric"),
        F.col("score_std").alias("value"),
        F.lit(10).cast("bigint").alias("n"),
        F.col("run_id").alias("run_dir"),
    )
    runs.write_documents(evals, eval_path)
    return runs.run_metrics(
        known,
        runs.read_documents(spark, summary_path, runs.SUMMARY_SCHEMA),
        runs.read_documents(spark, eval_path, runs.EVAL_SCHEMA),
    )


@query(
    "runs_scan",
    with_tables(
        "runs",
        extra=_METRICS,
        then=f"""SELECT r.run_id, s.model, s.metric, s.direction, {sql_round('s.first_score')} AS first_score,
        s.score_mean, s.score_std, e.oof_accuracy
        FROM runs r LEFT JOIN summaries s USING (run_id) LEFT JOIN evals e USING (run_id)""",
    ),
)
def runs_scan(spark, sf):
    found = run_metrics(spark, sf).select(
        "run_id",
        "model",
        "metric",
        "direction",
        F.get("fold_scores", F.lit(0)).alias("first_score"),
        "score_mean",
        "score_std",
        "oof_accuracy",
    )
    return rounded(found, "first_score")


# Of the run folders some have a summary, some a list of scores, some both with a broken summary.
_FOLDERS = f"""numbered AS (
  SELECT *, CAST(right(run_id, 6) AS INT) AS n, 'model+' || CAST(CAST(right(run_id, 6) AS INT) % 25 AS STRING) AS m FROM runs),
told AS (
  SELECT *, CASE WHEN model IS NULL THEN 'none' WHEN n % 5 = 0 THEN 'scores' WHEN n % 7 = 0 THEN 'none'
    ELSE 'summary' END AS kind FROM numbered)"""


def run_notes(spark, sf):
    """``(run_id, file, value)``: the files of a folder per run, of both generations."""
    n = F.substring("run_id", 5, 6).cast("int")
    low, high = F.col("score_mean") - F.col("score_std"), F.col("score_mean") + F.col("score_std")
    scores = F.array(low, high).alias("fold_scores")
    summary = F.to_json(F.struct("model", "metric", "direction", scores, "score_mean", "score_std"), {"pretty": True})
    evaluation = F.to_json(
        F.struct(
            F.when(n % 4 == 1, F.lit("accuracy")).otherwise(F.lit("other")).alias("metric"),
            F.col("score_std").alias("value"),
        )
    )
    trained = F.col("model").isNotNull()

    def file(name, value):
        return F.struct(name.alias("file"), value.alias("value"))

    files = F.array(
        file(F.lit("report.md"), F.lit("# Report")),
        F.when(trained & (n % 7 == 0), file(F.lit(run_folders.SUMMARY_FILE), F.lit('{"model": "x", broken'))),
        F.when(trained & (n % 7 != 0) & (n % 5 != 0), file(F.lit(run_folders.SUMMARY_FILE), summary)),
        F.when(
            trained & (n % 5 == 0),
            file(F.concat(F.lit("cv_scores_model+"), n % 25, F.lit(".json")), F.to_json(F.array(low, high))),
        ),
        F.when(n % 2 == 1, file(F.lit(run_folders.EVAL_FILE), evaluation)),
    )
    return derived.runs(spark, sf).select("run_id", F.inline(F.filter(files, lambda f: f.isNotNull())))


@query(
    "runs_scan_files",
    with_tables(
        "runs",
        extra=_FOLDERS,
        then=f"""SELECT run_id, NULLIF(kind, 'none') AS generation,
        CASE kind WHEN 'summary' THEN model WHEN 'scores' THEN m END AS model,
        CASE kind WHEN 'summary' THEN metric END AS metric, CASE kind WHEN 'summary' THEN direction END AS direction,
        CASE WHEN kind <> 'none' THEN {sql_round('score_mean - score_std')} END AS first_score,
        CASE WHEN kind <> 'none' THEN {sql_round('score_mean')} END AS score_mean,
        CASE WHEN kind <> 'none' THEN {sql_round('score_std')} END AS score_std,
        CASE WHEN n % 4 = 1 THEN score_std END AS oof_accuracy FROM told""",
    ),
)
def runs_scan_files(spark, sf):
    root = scratch.new_path(spark, "run-folders")
    run_folders.write_files(run_notes(spark, sf), root)
    found = run_folders.records(spark, root)
    metrics = runs.run_metrics(found, run_folders.summaries(found), run_folders.evaluations(found))
    shown = found.select("run_id", "generation").join(metrics, "run_id").select(
        "run_id",
        "generation",
        "model",
        "metric",
        "direction",
        F.get("fold_scores", F.lit(0)).alias("first_score"),
        "score_mean",
        "score_std",
        "oof_accuracy",
    )
    return rounded(shown, "first_score", "score_mean", "score_std")


@query("latest_run", with_tables("runs", then="SELECT max(run_id) AS run_id FROM runs"))
def latest_run(spark, sf):
    return runs.latest(derived.runs(spark, sf))


@query(
    "run_id_format",
    """SELECT o_orderkey AS row_id,
    strftime(o_orderdate + to_seconds(o_custkey), '%Y%m%d-%H%M%S') AS run_id,
    strftime(o_orderdate + to_seconds(o_custkey), '%Y-%m-%d %H:%M:%S') AS "timestamp" FROM orders""",
)
def run_id_format(spark, sf):
    moment = F.col("o_orderdate") + F.make_dt_interval(secs=F.col("o_custkey"))
    return load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        snapshot.run_stamp(moment).alias("run_id"),
        snapshot.ledger_stamp(moment).alias("timestamp"),
    )
