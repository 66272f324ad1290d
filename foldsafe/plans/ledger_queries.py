"""Ledger jobs and their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldsafe.functions import snapshot
from foldsafe.operators import ledger, training
from foldsafe.plans.registry import query, rounded, sql_round, with_tables
from foldsafe.plans.source_queries import _METRICS, run_metrics
from foldsafe.sources import derived, runs, scratch


_FLAGS = """CASE WHEN f LIKE '{%' THEN concat_ws(', ',
          'add_title=' || CASE json_extract_string(f, '$.add_title')
            WHEN 'true' THEN 'True' WHEN 'false' THEN 'False' END,
          'log_fare=' || CASE json_extract_string(f, '$.log_fare')
            WHEN 'true' THEN 'True' WHEN 'false' THEN 'False' END,
          'bin_age=' || json_extract_string(f, '$.bin_age')) END"""
_OBJECT = "CASE WHEN json_valid(cv_cfg) THEN CASE WHEN cv_cfg LIKE '{%' THEN cv_cfg END END"


@query(
    "ledger_append",
    with_tables(
        "ledger",
        "runs",
        extra=_METRICS,
        then="""SELECT l.entry_id, l."timestamp", l.file, l.message, l.run_id, l.threshold,
        e.oof_accuracy, CASE WHEN s.metric = 'auc' THEN s.score_mean END AS oof_auc_mean,
        s.model AS cv_model, l.leaderboard_score, l.features_cfg, l.models_cfg, l.cv_cfg,
        l.competition
        FROM ledger l LEFT JOIN summaries s USING (run_id) LEFT JOIN evals e USING (run_id)""",
    ),
)
def ledger_append(spark, sf):
    # Two batches go to one ledger, which is then read back.
    entries = derived.ledger(spark, sf)
    path = scratch.new_path(spark, "ledger")
    recorded = ledger.record(entries, run_metrics(spark, sf))
    ledger.append(recorded.filter("run_id IS NULL"), path)
    ledger.append(recorded.filter("run_id IS NOT NULL"), path)
    return ledger.read(spark, path, "entry_id bigint")


@query(
    "ledger_json",
    with_tables(
        "ledger",
        extra="""checked AS (SELECT entry_id, cv_cfg,
          CASE WHEN json_valid(features_cfg) THEN features_cfg END AS f,
          CASE WHEN json_valid(models_cfg) THEN models_cfg END AS m FROM ledger)""",
        then=f"""SELECT entry_id, {_FLAGS} AS features,
        json_extract_string(m, '$[0].name') AS first_model, {_OBJECT} AS cv FROM checked""",
    ),
)
def ledger_json(spark, sf):
    return derived.ledger(spark, sf).select(
        "entry_id",
        snapshot.flag_summary(F.col("features_cfg")).alias("features"),
        snapshot.first_model(F.col("models_cfg")).alias("first_model"),
        snapshot.json_object(F.col("cv_cfg")).alias("cv"),
    )


_REPORT = (
    _METRICS
    + """,
rates AS (SELECT file, avg(CAST(label = 1 AS INT)) AS pred_pos_rate FROM submissions GROUP BY file),
labelled AS (SELECT run_id, oof, target FROM run_oof JOIN passengers USING (row_id)),
cuts AS (SELECT DISTINCT run_id, coalesce(threshold, CAST(0.5 AS DOUBLE)) AS cut FROM ledger
  WHERE oof_accuracy IS NULL AND run_id IS NOT NULL),
computed AS (SELECT run_id, cut, avg(CAST(CAST(oof >= cut AS INT) = target AS INT)) AS accuracy
  FROM cuts JOIN labelled USING (run_id) GROUP BY run_id, cut),
report AS (
  SELECT l.* EXCLUDE (oof_accuracy), coalesce(l.oof_accuracy, c.accuracy) AS oof_accuracy,
    r.pred_pos_rate, s.model, s.metric AS cv_metric, s.score_mean AS cv_score_mean,
    s.score_std AS cv_score_std
  FROM ledger l LEFT JOIN rates r USING (file) LEFT JOIN summaries s USING (run_id)
  LEFT JOIN computed c ON c.run_id = l.run_id AND c.cut = coalesce(l.threshold, CAST(0.5 AS DOUBLE)))"""
)
_TABLES = ("ledger", "runs", "submissions", "run_oof", "passengers")


def _report(spark, sf):
    return ledger.report(
        derived.ledger(spark, sf),
        run_metrics(spark, sf),
        derived.submissions(spark, sf),
        derived.run_oof(spark, sf),
        derived.order_labels(spark, sf),
        "row_id",
        "target",
    )


def _stored_report(spark, sf):
    """The report as a table: rankings read it more than once."""
    return scratch.written(_report(spark, sf), "report")


@query(
    "ledger_report",
    with_tables(
        *_TABLES,
        extra=_REPORT,
        then=f"""SELECT entry_id, file, run_id, threshold, {sql_round('oof_accuracy')} AS oof_accuracy,
        {sql_round('pred_pos_rate')} AS pred_pos_rate, model, cv_metric, cv_score_mean, cv_score_std
        FROM report""",
    ),
)
def ledger_report(spark, sf):
    found = _report(spark, sf).select(
        "entry_id",
        "file",
        "run_id",
        "threshold",
        "oof_accuracy",
        "pred_pos_rate",
        "model",
        "cv_metric",
        "cv_score_mean",
        "cv_score_std",
    )
    return rounded(found, "oof_accuracy", "pred_pos_rate")


_TOP = (
    _REPORT
    + """,
ranked AS (
  SELECT * FROM (SELECT 'leaderboard' AS ranking, *,
    row_number() OVER (ORDER BY leaderboard_score DESC, entry_id) AS rank
    FROM report WHERE leaderboard_score IS NOT NULL) WHERE rank <= 5
  UNION ALL
  SELECT * FROM (SELECT 'oof_accuracy' AS ranking, *,
    row_number() OVER (ORDER BY oof_accuracy DESC, entry_id) AS rank
    FROM report WHERE oof_accuracy IS NOT NULL) WHERE rank <= 5),
last AS (SELECT file, """ + _FLAGS + """ AS features, models_cfg, """ + _OBJECT + """ AS cv FROM (
  SELECT *, CASE WHEN json_valid(features_cfg) THEN features_cfg END AS f,
    row_number() OVER (PARTITION BY file ORDER BY entry_id DESC) AS back FROM ledger) WHERE back = 1),
told AS (SELECT r.*, nullif(l.features, '') AS features, l.cv,
  CASE WHEN json_valid(l.models_cfg) THEN json_extract_string(l.models_cfg, '$[0].name') END AS models_cfg_first,
  CASE WHEN length(message) > 80 THEN substr(message, 1, 77) || '...' ELSE nullif(message, '') END AS note
  FROM ranked r JOIN last l USING (file))"""
)


@query(
    "ledger_topk",
    with_tables(
        *_TABLES,
        extra=_TOP,
        then=f"""SELECT ranking, CAST(rank AS INT) AS rank, r."timestamp", file, r.run_id,
        coalesce(nullif(model, ''), nullif(cv_model, '')) AS model, r.threshold,
        round_even(pred_pos_rate, 3) AS pred_pos_rate, oof_auc_mean, {sql_round('oof_accuracy')} AS oof_accuracy,
        leaderboard_score,
        features, models_cfg_first, cv, note FROM told r""",
    ),
)
def ledger_topk(spark, sf):
    found = ledger.topk(_stored_report(spark, sf), derived.ledger(spark, sf), 5, ["entry_id"])
    return rounded(found.withColumn("features", F.nullif("features", F.lit(""))), "oof_accuracy")


@query(
    "ledger_lines",
    with_tables(
        *_TABLES,
        extra=_TOP,
        then="""SELECT ranking, CAST(rank AS INT) AS rank,
        '- ' || r."timestamp" || ': model=' || coalesce(nullif(model, ''), nullif(cv_model, ''), 'nan') AS start,
        '  file=' || file AS file_line, '  run_dir=' || coalesce(r.run_id, 'nan') AS run_line,
        concat_ws(chr(10), '  features: ' || features, '  models_cfg_first: ' || nullif(models_cfg_first, ''),
          '  cv: ' || nullif(cv, ''), '  note: ' || note) AS rest
        FROM told r""",
    ),
)
def ledger_lines(spark, sf):
    top = ledger.topk(_stored_report(spark, sf), derived.ledger(spark, sf), 5, ["entry_id"])
    parts = F.split("text", "\n")
    return ledger.lines(top).select(
        "ranking",
        "rank",
        F.substring_index(parts[0], ", thr=", 1).alias("start"),
        parts[1].alias("file_line"),
        parts[2].alias("run_line"),
        F.array_join(F.slice(parts, 4, 9), "\n").alias("rest"),
    )


def _sql_short(value: str) -> str:
    return f"regexp_replace(rtrim(printf('%.5f', {value}), '0'), '\\.$', '.0')"


@query(
    "run_report",
    with_tables(
        "runs",
        extra="""saved AS (SELECT run_id, model, floor(score_mean * 1000) / 1000 AS a, score_std AS b,
          CAST(right(run_id, 6) AS INT) AS n FROM runs),
        line AS (SELECT *, chr(10) AS nl FROM saved)""",
        then=f"""SELECT run_id, '# Model Training Report' || nl || nl || '**Run Directory:** ' || run_id || nl || nl
        || '## Best Model' || nl || '- Name: `' || coalesce(model, 'None') || '`' || nl
        || '- Parameters: `' || CASE WHEN n % 3 = 0 THEN '{{}}' ELSE '{{"alpha": ' || CAST(n AS STRING) || '}}' END || '`'
        || nl || nl || '## Cross-Validation Scores' || nl || '- Fold scores: [' || {_sql_short('a')} || ', '
        || CASE WHEN n % 5 = 0 THEN 'None' ELSE {_sql_short('b')} END || ']' || nl
        || '- Mean CV score: ' || {_sql_short('a')} || nl || nl || '## Features Used' || nl
        || CASE WHEN n % 4 = 0 THEN '' ELSE '- log_fare: True' || nl || '- bin_age: ' || CAST(n AS STRING) || nl END || nl
        || '## Config Snapshot' || nl || '### cv' || nl || 'scheme: kfold' || nl || 'group_column: None' AS report
        FROM line""",
    ),
)
def run_report(spark, sf):
    # Summaries are saved as a run saves them, in two versions, and each run's report is made of the later one.
    n = F.substring("run_id", 5, 6).cast("int")
    a, b = F.floor(F.col("score_mean") * 1000) / 1000, F.when(n % 5 != 0, F.col("score_std"))
    first = derived.runs(spark, sf).select(
        "run_id",
        "model",
        F.array(a, b).alias("fold_scores"),
        a.alias("score_mean"),
        F.when(n % 3 != 0, F.concat(F.lit('{"alpha": '), n, F.lit("}"))).alias("params"),
        F.when(n % 4 == 0, F.lit("[1]"))
        .otherwise(F.concat(F.lit('{"log_fare": true, "bin_age": '), n, F.lit("}")))
        .alias("features_cfg"),
        F.lit('{"scheme": "kfold", "group_column": null}').alias("cv_cfg"),
        F.lit("2024-01-02 00:00:00").cast("timestamp").alias("saved_at"),
    )
    path = scratch.new_path(spark, "summaries")
    runs.write_documents(first, path)
    earlier = first.withColumns({"model": F.lit("earlier"), "saved_at": F.lit("2024-01-01 00:00:00").cast("timestamp")})
    runs.write_documents(earlier, path)
    return training.run_report(runs.last_saved(runs.read_documents(spark, path, runs.SUMMARY_SCHEMA)))
