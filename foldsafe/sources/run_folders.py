"""Runs that lie in a folder each, as files of either generation, read with one scan per kind of file.

A run is a folder directly below the root that holds at least one file directly that is not empty. The older trainer left
``cv_summary.json`` and ``oof.csv`` there, the newer one ``cv_scores_<model>.json``; an evaluation
adds ``oof_eval.json``. A file that is missing, empty or no JSON leaves its fields null, a field of
another type only itself. Folders and files whose names begin with ``.`` or ``_`` are unfinished writes.

Spark lists the folders in tasks, from the root down, so the driver does not visit a folder per run; files that lie deeper than
a run's own are listed too and left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsafe.sources.runs import EVAL_SCHEMA, SUMMARY_SCHEMA

# The names of a run's files, and the kinds of file a run folder may hold.
SUMMARY_FILE = "cv_summary.json"
EVAL_FILE = "oof_eval.json"
OOF_FILE = "oof.csv"
SCORES_FILE = "cv_scores_*.json"
_SCORES = r"^cv_scores_(.+)\.json$"
_ANY_FILE = "*.{json,csv,md,npy,joblib}"

# Parts per core in which files are written.
_WRITE_PARTS = 2

_NOTES = T.StructType([T.StructField(n, T.StringType()) for n in ("run_id", "file", "value")])
_OOF = "run_id string, id string, oof string"


def _part(back: int) -> Column:
    """A part of the file's path, counted from its end; paths are URIs, in which a plus is a plus."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    return F.url_decode(F.replace(F.element_at(parts, -back), F.lit("+"), F.lit("%2B")))


def _depth(spark: SparkSession, root: str) -> int:
    """How many folders deep the root lies in its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path)
    return len([p for p in whole.toUri().getPath().split("/") if p])


def _scanned(spark: SparkSession, kind: str, root: str, names: str, schema: str, **options: object) -> DataFrame | None:
    """A scan of the files of these names directly in a folder below the root, with `run_id` and `file`; None without a root."""
    reader = spark.read.format(kind).options(recursiveFileLookup=True, pathGlobFilter=names, **options)
    try:
        scan = reader.schema(schema).load(root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    # Spark drops files by these filters on the driver, where scans that start at once share them: only functions without
    # a state of their own, so no pattern replacement and no lambda.
    whole = F.col("_metadata.file_path")
    slashes = F.length(whole) - F.length(F.replace(whole, F.lit("/"), F.lit("")))
    own = slashes - F.when(F.contains(whole, F.lit("://")), 2).otherwise(0) == _depth(spark, root) + 2
    found = scan.filter(own).withColumns({"run_id": _part(2), "file": _part(1)})
    return found.filter(~(F.startswith("run_id", F.lit(".")) | F.startswith("run_id", F.lit("_"))))


def run_ids(spark: SparkSession, root: str) -> DataFrame:
    """``(run_id)``: every run folder. Files are listed, not opened."""
    listing = "path string, modificationTime timestamp, length bigint, content binary"
    scan = _scanned(spark, "binaryFile", root, _ANY_FILE, listing)
    if scan is None:
        return spark.createDataFrame([], "run_id string")
    return scan.select("run_id").distinct()


def notes(spark: SparkSession, root: str) -> DataFrame:
    """``(run_id, file, value)``: the whole text of every JSON file of every run."""
    names = f"{{{SUMMARY_FILE},{EVAL_FILE},{SCORES_FILE}}}"
    scan = _scanned(spark, "text", root, names, "value string", wholetext=True)
    if scan is None:
        return spark.createDataFrame([], _NOTES)
    return scan.select("run_id", "file", "value")


def _scores_summary(text: Column, model: Column) -> Column:
    """A summary made of a list of fold scores; folds without a score do not count."""
    scores = F.from_json(text, "array<double>")
    known = F.filter(scores, lambda s: s.isNotNull())
    n = F.size(known).cast("double")

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, s: a + s)

    mean = total(known) / n
    spread = F.sqrt(total(F.transform(known, lambda s: (s - mean) * (s - mean))) / n)
    made = {"model": model, "fold_scores": scores, "score_mean": mean, "score_std": spread}
    fields = [made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SUMMARY_SCHEMA]
    return F.when(F.size(known) > 0, F.struct(*fields))


def records(spark: SparkSession, root: str) -> DataFrame:
    """``(run_id, generation, summary, evaluation)`` per run folder, with structs that may be null.

    A summary that can be read wins over a list of scores; of several lists (one per model) the one with
    the greatest mean counts, then the smallest model name, since the newer trainer maximises.
    """
    file, text = F.col("file"), F.col("value")
    summary = F.from_json(text, SUMMARY_SCHEMA)
    evaluation = F.from_json(text, EVAL_SCHEMA)
    scores = _scores_summary(text, F.regexp_extract(file, _SCORES, 1))
    read = notes(spark, root).select(
        "run_id",
        "file",
        F.when((file == SUMMARY_FILE) & (summary["model"].isNotNull() | summary["score_mean"].isNotNull()), summary)
        .alias("old"),
        F.when(file.rlike(_SCORES), scores).alias("new"),
        F.when((file == EVAL_FILE) & evaluation["metric"].isNotNull(), evaluation).alias("evaluation"),
    )
    # The greatest mean; among equals the smallest model name: the smallest of (-mean, name).
    place = F.when(F.col("new").isNotNull(), F.struct(-F.col("new.score_mean"), F.col("new.model")))
    told = read.groupBy("run_id").agg(
        F.any_value("old", True).alias("old"),
        F.min_by("new", place).alias("new"),
        F.any_value("evaluation", True).alias("evaluation"),
    )
    generation = F.when(F.col("old").isNotNull(), "summary").when(F.col("new").isNotNull(), "scores")
    return run_ids(spark, root).join(told, "run_id", "left").select(
        "run_id", generation.alias("generation"), F.coalesce("old", "new").alias("summary"), "evaluation"
    )


def summaries(found: DataFrame) -> DataFrame:
    """The runs of `records` that have a summary, in the columns of the summary table."""
    return found.filter(F.col("summary").isNotNull()).select("run_id", "summary.*")


def evaluations(found: DataFrame) -> DataFrame:
    return found.filter(F.col("evaluation").isNotNull()).select("run_id", "evaluation.*")


def read_oof(spark: SparkSession, root: str, id_col: str, id_type: str = "bigint") -> DataFrame:
    """``(run_id, <id_col>, oof)``: the out-of-fold rows of all runs, in one scan that splits large files.

    Files of other columns than the id and the score, in this order, are left out: without an id rows
    cannot be aligned. A score that is blank or no number is null.
    """
    scan = _scanned(spark, "csv", root, OOF_FILE, "id string, oof string, more string", escape='"')
    if scan is None:
        return spark.createDataFrame([], f"run_id string, `{id_col}` {id_type}, oof double")
    rows = scan.select("run_id", "id", "oof", "more")
    # Only a header holds this text in place of a number, so a file that is split has one, too.
    header = F.col("oof") == "oof"
    usable = rows.filter(header & (F.col("id") == id_col) & F.col("more").isNull()).select("run_id")
    return rows.filter(~F.coalesce(header, F.lit(False))).join(usable, "run_id", "left_semi").select(
        "run_id", F.col("id").try_cast(id_type).alias(id_col), F.col("oof").try_cast("double").alias("oof")
    )


def write_files(files: DataFrame, root: str) -> int:
    """Write ``(run_id, file, value)`` as one small file per row below `root`; gives their number.

    The rows are dealt out evenly first, so every core writes. A task that runs again writes the same files again.
    """
    root = "file:///" + root[5:].lstrip("/") if root.startswith("file:") else root

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                system.create_dir(f"{base}/{row['run_id']}", recursive=True)
                with system.open_output_stream(f"{base}/{row['run_id']}/{row['file']}") as out:
                    out.write(row["value"].encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    cores = files.sparkSession.sparkContext.defaultParallelism
    # All files of a run in one task.
    dealt = files.select("run_id", "file", "value").repartition(_WRITE_PARTS * cores, "run_id")
    made = dealt.mapInArrow(task, "n long")
    return made.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
