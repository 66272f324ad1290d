"""Run tables: one row of metrics per run, out-of-fold rows, fold models."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsafe.errors import InferenceError

# The fields of a run summary and of an evaluation.
SUMMARY_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("direction", T.StringType()),
        T.StructField("fold_scores", T.ArrayType(T.DoubleType())),
        T.StructField("score_mean", T.DoubleType()),
        T.StructField("score_std", T.DoubleType()),
        T.StructField("pipelines", T.ArrayType(T.StringType())),
        T.StructField("params", T.StringType()),
        T.StructField("features_cfg", T.StringType()),
        T.StructField("cv_cfg", T.StringType()),
        T.StructField("saved_at", T.TimestampType()),
    ]
)
EVAL_SCHEMA = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("n", T.LongType()),
        T.StructField("run_dir", T.StringType()),
        T.StructField("saved_at", T.TimestampType()),
    ]
)


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON records of many runs in one scan; a record that does not parse is left out."""
    typed = T.StructType([*schema.fields, T.StructField("run_id", T.StringType())])
    found = spark.read.schema(typed).option("mode", "PERMISSIVE").json(path)
    return found.filter(F.col("run_id").isNotNull())


def last_saved(documents: DataFrame) -> DataFrame:
    """One record per run: the one saved last, whole; records without a time count as earliest."""
    order = F.struct(F.col("saved_at").isNotNull(), "saved_at")
    fields = F.struct(*[c for c in documents.columns if c != "run_id"])
    return documents.groupBy("run_id").agg(F.max_by(fields, order).alias("_last")).select("run_id", "_last.*")


def write_documents(df: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON record per row; a run adds to the table, never rewrites it.

    The run is a field, not a folder: a folder per run would mean a file per run to list and open.
    """
    df.write.mode(mode).json(path)


def run_metrics(runs: DataFrame, summaries: DataFrame, evals: DataFrame) -> DataFrame:
    """Every run with what is known about it; runs without a summary or evaluation keep nulls."""
    cv = summaries.select(
        "run_id", "model", "metric", "direction", "fold_scores", "score_mean", "score_std"
    )
    accuracy = evals.select(
        "run_id",
        F.when(F.col("metric") == "accuracy", F.col("value")).alias("oof_accuracy"),
    )
    return runs.select("run_id").join(cv, "run_id", "left").join(accuracy, "run_id", "left")


def latest(runs: DataFrame) -> DataFrame:
    """One row with the run whose name sorts last; stamps sort by time."""
    return runs.agg(F.max("run_id").alias("run_id"))


def latest_id(runs: DataFrame) -> str:
    found = latest(runs).first()["run_id"]
    if found is None:
        raise InferenceError("there are no runs yet")
    return found


def write_oof(oof: DataFrame, path: str) -> None:
    """Out-of-fold rows; the partition folders let readers skip other runs and models.

    Only the folders of the given runs and models are replaced, so saving again changes nothing.
    """
    writer = oof.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id", "model").parquet(path)


def read_oof(spark: SparkSession, path: str) -> DataFrame:
    """Out-of-fold rows; run and model names are text, also where they look like numbers."""
    kinds = {"run_id": T.StringType(), "model": T.StringType()}
    found = spark.read.parquet(path).schema
    schema = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in found])
    return spark.read.schema(schema).parquet(path)


def read_if_any(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of a table that may not have been written yet."""
    try:
        return read_documents(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        typed = T.StructType([*schema.fields, T.StructField("run_id", T.StringType())])
        return spark.createDataFrame([], typed)
