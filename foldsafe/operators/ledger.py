"""Submissions ledger: record entries, enrich them with run metrics, rank and summarise them.

A ledger row has a ``run_id`` (null if none), a ``file`` and, to tell the last entry of a file, one
or more columns that order entries by the time they were appended.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsafe.functions import snapshot
from foldsafe.functions.numeric import known
from foldsafe.functions.text import ellipsis, first_filled
from foldsafe.operators.cells import CELL, NumericCells
from foldsafe.operators.metrics import align
from foldsafe.operators.profile import positive_rate
from foldsafe.operators.ranks import running_totals

DEFAULT_THRESHOLD = 0.5
# The fields of a ledger entry.
ENTRY = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("competition", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("oof_accuracy", T.DoubleType()),
        T.StructField("oof_auc_mean", T.DoubleType()),
        T.StructField("cv_model", T.StringType()),
        T.StructField("leaderboard_score", T.DoubleType()),
        T.StructField("features_cfg", T.StringType()),
        T.StructField("models_cfg", T.StringType()),
        T.StructField("cv_cfg", T.StringType()),
    ]
)


def record(entries: DataFrame, run_metrics: DataFrame) -> DataFrame:
    """Complete new entries with what their run is known to have reached.

    The accuracy comes from an evaluation that measured accuracy, the mean AUC from a run whose
    metric is AUC; otherwise they stay null.
    """
    reached = run_metrics.select(
        "run_id",
        F.col("oof_accuracy"),
        F.when(F.col("metric") == "auc", F.col("score_mean")).alias("oof_auc_mean"),
        F.col("model").alias("cv_model"),
    )
    bare = entries.drop("oof_accuracy", "oof_auc_mean", "cv_model")
    named = bare.filter(F.col("run_id").isNotNull()).join(reached, "run_id", "left")
    # Entries without a run, which may be most, skip the join and stay where they are.
    full = named.unionByName(bare.filter(F.col("run_id").isNull()), allowMissingColumns=True)
    extra = [c for c in full.columns if c not in ENTRY.names]
    return full.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in ENTRY], *extra
    )


def append(entries: DataFrame, path: str) -> None:
    """Add JSON records to the ledger. One table serves all runs: a run's own ledger is a filter."""
    entries.write.mode("append").json(path)


def read(spark: SparkSession, path: str, extra: str | None = None) -> DataFrame:
    schema = ENTRY
    if extra:
        schema = T.StructType([*ENTRY.fields, *T.StructType.fromDDL(extra).fields])
    return spark.read.schema(schema).json(path)


def accuracy_at(
    scored: DataFrame,
    marks: DataFrame,
    label: str,
    score: str,
    by: str = "run_id",
    spread: DataFrame | None = None,
) -> DataFrame:
    """``(by, threshold, accuracy)`` of each group's rows at each of the group's thresholds.

    Thresholds are put among the distinct scores; running counts up to a threshold say how many
    rows it gets right. Rows are read once, however many thresholds a group has. ``spread`` is a
    cheaper table with the same scores to choose the work split from; it never changes the result.
    """
    lowest = F.lit(float("-inf"))
    rows = scored.select(
        by, F.col(label).alias("_y"), F.coalesce(known(F.col(score)), lowest).alias("_at")
    )
    points = rows.groupBy(by, "_at").agg(
        F.count_if(F.col("_y") == 1).alias("pos"),
        F.count_if(F.col("_y") == 0).alias("neg"),
        F.count(F.lit(1)).alias("rows"),
    )
    nothing = F.lit(0).cast("bigint")
    wanted = marks.select(
        by,
        F.col("threshold").cast("double").alias("_at"),
        nothing.alias("pos"),
        nothing.alias("neg"),
        nothing.alias("rows"),
    ).distinct()
    # A mark sorts before the scores equal to it: those pass the threshold.
    mixed = points.withColumn("_mark", F.lit(1)).unionByName(wanted.withColumn("_mark", F.lit(0)))
    cells = NumericCells.learn(scored if spread is None else spread, known(F.col(score)))
    summed = running_totals(
        cells.add(mixed, F.col("_at")), [by], CELL, ["_at", "_mark"], ["pos", "neg"]
    )
    totals = points.groupBy(by).agg(F.sum("pos").alias("_pos"), F.sum("rows").alias("_rows"))
    right = F.col("neg_before") + F.col("_pos") - F.col("pos_before")
    return (
        summed.filter(F.col("_mark") == 0)
        .join(totals, by)
        .select(by, F.col("_at").alias("threshold"), (right / F.col("_rows")).alias("accuracy"))
    )


def report(
    ledger: DataFrame,
    run_metrics: DataFrame,
    submissions: DataFrame,
    oof: DataFrame,
    labels: DataFrame,
    id_col: str,
    target: str,
    label: str = "label",
) -> DataFrame:
    """Every ledger row with its positive rate, run metrics and out-of-fold accuracy.

    The accuracy is computed at the entry's threshold only where the ledger has none. Each side is
    reduced to one row per key before its join, so the report has exactly the ledger's rows.
    """
    rates = positive_rate(submissions, "file", label)
    cut = F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD))
    open_cuts = ledger.filter(F.col("oof_accuracy").isNull() & F.col("run_id").isNotNull())
    open_cuts = open_cuts.select("run_id", cut.alias("threshold")).distinct()
    # Runs without an open entry are not read any further.
    needed = oof.join(open_cuts.select("run_id").distinct(), "run_id", "left_semi")
    computed = accuracy_at(
        align(needed, labels, id_col, target), open_cuts, target, "oof", spread=oof
    )
    computed = computed.select(
        "run_id", F.col("threshold").alias("_cut"), F.col("accuracy").alias("_computed")
    )
    facts = run_metrics.select(
        "run_id",
        "model",
        F.col("metric").alias("cv_metric"),
        F.to_json("fold_scores").alias("cv_fold_scores"),
        F.col("score_mean").alias("cv_score_mean"),
        F.col("score_std").alias("cv_score_std"),
    )
    rated = ledger.withColumn("_cut", cut).join(rates, "file", "left")
    named = rated.filter(F.col("run_id").isNotNull()).join(facts, "run_id", "left")
    named = named.join(computed, ["run_id", "_cut"], "left")
    # Entries without a run, which may be most, skip these joins and stay where they are.
    unnamed = rated.filter(F.col("run_id").isNull())
    return (
        named.unionByName(unnamed, allowMissingColumns=True)
        .withColumn("oof_accuracy", F.coalesce("oof_accuracy", "_computed"))
        .drop("_cut", "_computed")
    )


def _top(reported: DataFrame, score: str, k: int, order: Sequence[str]) -> DataFrame:
    ranked = reported.filter(F.col(score).isNotNull()).orderBy(F.desc(score), *order).limit(k)
    listed = ranked.agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col(score)).alias("_by"), *order, F.struct("*").alias("row")))
        ).alias("rows")
    )
    return listed.select(F.posexplode("rows").alias("rank", "entry")).select(
        (F.col("rank") + 1).alias("rank"), "entry.row.*"
    )


def topk(
    reported: DataFrame, ledger: DataFrame, k: int = 5, order: Sequence[str] = ("timestamp",)
) -> DataFrame:
    """The ``k`` best entries by leaderboard score and by out-of-fold accuracy.

    Each comes with the settings of the last ledger entry of its file. Only entries of the few
    files in question are looked through for that.
    """
    best = _top(reported, "leaderboard_score", k, order).withColumn("ranking", F.lit("leaderboard"))
    best = best.unionByName(
        _top(reported, "oof_accuracy", k, order).withColumn("ranking", F.lit("oof_accuracy"))
    )
    settings = F.struct("features_cfg", "models_cfg", "cv_cfg")
    # At most 2k file names are broadcast.
    files = F.broadcast(best.select("file").distinct())
    last = (
        ledger.join(files, "file", "left_semi")
        .groupBy("file")
        .agg(F.max_by(settings, F.struct(*order)).alias("_last"))
    )
    return (
        best.drop("features_cfg", "models_cfg", "cv_cfg")
        .join(last, "file", "left")
        .select(
            "ranking",
            "rank",
            "timestamp",
            "file",
            "run_id",
            first_filled(F.col("model"), F.col("cv_model")).alias("model"),
            "threshold",
            F.bround("pred_pos_rate", 3).alias("pred_pos_rate"),
            "oof_auc_mean",
            "oof_accuracy",
            "leaderboard_score",
            snapshot.flag_summary(F.col("_last.features_cfg")).alias("features"),
            snapshot.first_model(F.col("_last.models_cfg")).alias("models_cfg_first"),
            snapshot.json_object(F.col("_last.cv_cfg")).alias("cv"),
            ellipsis(F.nullif("message", F.lit(""))).alias("note"),
        )
    )


def _shown(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("nan"))


def _line(label: str, name: str) -> Column:
    text = F.nullif(F.col(name), F.lit(""))
    return F.when(text.isNotNull(), F.concat(F.lit(f"  {label}: "), text))


def lines(top: DataFrame) -> DataFrame:
    """``(ranking, rank, text)``: one Markdown list item per ranked entry."""
    # The wording and order of a summary's lines and headings.
    head = F.format_string(
        "- %s: model=%s, thr=%s, pred_pos_rate=%s; OOF AUC=%s, OOF acc=%s, LB=%s",
        *[
            _shown(c)
            for c in (
                "timestamp",
                "model",
                "threshold",
                "pred_pos_rate",
                "oof_auc_mean",
                "oof_accuracy",
                "leaderboard_score",
            )
        ],
    )
    text = F.concat_ws(
        "\n",
        head,
        F.concat(F.lit("  file="), _shown("file")),
        F.concat(F.lit("  run_dir="), _shown("run_id")),
        _line("features", "features"),
        _line("models_cfg_first", "models_cfg_first"),
        _line("cv", "cv"),
        _line("note", "note"),
    )
    return top.select("ranking", "rank", text.alias("text")).orderBy("ranking", "rank")


def write_markdown(top: DataFrame, path: str) -> None:
    """Summary document: a heading per ranking, then its entries in rank order (at most 2k items)."""
    heading = {"leaderboard": "## Top by Leaderboard Score", "oof_accuracy": "## Top by OOF Accuracy"}
    titles = F.create_map(*[F.lit(part) for pair in heading.items() for part in pair])
    blocks = (
        lines(top)
        .groupBy("ranking")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("items"))
        .select(
            "ranking",
            F.concat_ws(
                "\n\n", titles[F.col("ranking")], F.array_join(F.col("items.text"), "\n\n")
            ).alias("block"),
        )
    )
    body = F.array_join(F.array_sort(F.collect_list(F.struct("ranking", "block")))["block"], "\n\n")
    document = blocks.agg(F.concat(F.lit("# Submissions Summary\n\n"), body).alias("value"))
    document.coalesce(1).write.text(path)
