"""Regressions: CSV by header and untrimmed, infinities, nulls, weights, saves, evaluations."""

import math

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.ml import Pipeline
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsafe import SchemaError
from foldsafe.functions import snapshot
from foldsafe.jobs import Store
from foldsafe.operators import ensemble, quantiles, ranks, scoring, splits
from foldsafe.sources import csv, runs


def test_csv_schema_goes_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,a,b\n1,x,2.5\n2,y,NA\n")
    schema = T.StructType([
        T.StructField("b", T.DoubleType()), T.StructField("a", T.StringType()), T.StructField("id", T.LongType())
    ])
    df = csv.read(spark, str(tmp_path / "a.csv"), schema)
    assert df.columns == ["b", "a", "id"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(2.5, "x", 1), (None, "y", 2)]
    with pytest.raises(SchemaError):
        csv.read(spark, str(tmp_path / "a.csv"), schema.add("missing", T.LongType()))


def test_csv_keeps_padding_and_line_breaks(spark, tmp_path):
    rows = [(1, "  padded  "), (2, 'two\nlines, "quoted"'), (3, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    csv.write(df, old)
    assert sorted(map(tuple, csv.read(spark, old, multiline=True).collect())) == rows
    more = spark.createDataFrame([(4, "a\nb")], "id long, t string")
    assert sorted(map(tuple, csv.append(more, old, new).collect())) == [*rows, (4, "a\nb")]


def test_selection_with_minus_infinity(spark):
    values = [-math.inf] * 50 + list(range(100)) + [math.inf] * 10
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    places = [0, 49, 50, 51, 149, 150, 159]
    found = quantiles.select(df, {"v": F.col("v")}, [("v", p) for p in places], settle_rows=5)
    assert [found["v", p] for p in places] == [sorted(map(float, values))[p] for p in places]


def test_ranks_and_folds_keep_null_rows(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("y"))
    for column in ({"class_col": "y"}, {"order_col": "y"}):
        assert sorted(r["rank"] for r in ranks.global_rank(df, "id", **column).collect()) == list(range(100))
    folds = splits.stratified(df, "id", "y", 5).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("y").isNull()).alias("none")
    )
    assert {(r["n"], r["none"]) for r in folds.collect()} == {(20, 4)}


def test_stratified_needs_classes(spark):
    many = spark.range(3000).select("id", F.col("id").alias("y"))
    with pytest.raises(SchemaError):
        splits.stratified(many, "id", "y")
    with pytest.raises(SchemaError):
        splits.stratified(many.select("id", (F.col("id") % 2 + 0.5).alias("y")), "id", "y")


def test_weights_count_where_the_source_has_the_row(spark):
    long = spark.createDataFrame(
        [(1, "a", 1.0), (2, "a", 1.0), (2, "b", 0.0), (3, "b", None)], "id long, source string, p double"
    )
    got = {r["id"]: r["p"] for r in ensemble.weighted(long, {"a": 1, "b": 3}, "id").collect()}
    assert got == {1: 1.0, 2: 0.25, 3: None}


def test_best_regression_keeps_its_value(spark):
    df = spark.createDataFrame([(i, float(i), i + 0.5) for i in range(20)], "id long, x double, y double")
    model = Pipeline(stages=[
        VectorAssembler(inputCols=["x"], outputCol="f"), LinearRegression(featuresCol="f", labelCol="y")
    ]).fit(df)
    got = scoring.predict_best(model, df.drop("y"), "id", "y", task="regression").collect()
    assert [r["y"] for r in sorted(got)] == pytest.approx([i + 0.5 for i in range(20)], abs=1e-3)


def test_only_objects_are_settings(spark):
    texts = ['{"a": 1}', "[1, 2]", '"x"', "7", "broken", "", None, ' {"b": 2}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(snapshot.json_object(F.col("t"))).collect()]
    assert got == ['{"a": 1}', None, None, None, None, None, None, ' {"b": 2}']


def test_the_last_evaluation_counts_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path), "id", "y")
    assert store.evaluations().count() == 0
    for value, stamp in ((0.9, "2024-01-01 00:00:00"), (0.6, "2024-01-02 00:00:00")):
        row = spark.createDataFrame([("r1", "accuracy", value, 3, "r1")], "run_id string, metric string, value double, n long, run_dir string")
        runs.write_documents(row.withColumn("saved_at", F.to_timestamp(F.lit(stamp))), f"{tmp_path}/oof_eval")
    assert [tuple(r) for r in store.evaluations().collect()] == [("r1", "accuracy", 0.6)]


def test_saving_rows_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "oof")
    rows = spark.createDataFrame([(i, 0.5, "001", "m") for i in range(6)], "id long, oof double, run_id string, model string")
    runs.write_oof(rows, path)
    runs.write_oof(rows, path)
    runs.write_oof(rows.withColumn("run_id", F.lit("002")), path)
    got = runs.read_oof(spark, path)
    assert dict(got.dtypes)["run_id"] == "string"
    assert {r["run_id"]: r["count"] for r in got.groupBy("run_id").count().collect()} == {"001": 6, "002": 6}


def _joins(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(line.lstrip(" :+-").startswith("Join") for line in plan.splitlines())


def test_group_folds_and_features_have_small_plans(spark, folder):
    from foldsafe.plans import REGISTRY

    for name in ("group_assign", "features_loo"):
        assert _joins(REGISTRY[name].build(spark, folder)) <= 6


def test_jobs_refuse_repeated_labels_and_warn(spark, tmp_path, caplog):
    from foldsafe import jobs

    store = Store(spark, str(tmp_path), "id", "y")
    oof = spark.createDataFrame([(i, 0.5) for i in range(4)], "id long, oof double")
    labels = spark.createDataFrame([(i, 1) for i in range(3)], "id long, y int")
    with caplog.at_level("WARNING"):
        jobs._aligned(oof, labels, store)
    assert "3 of 4" in caplog.text
    with pytest.raises(SchemaError):
        jobs._aligned(oof, labels.unionByName(labels), store)


def test_row_ids(spark):
    rows = [(None, "b"), (1, "a"), (1, "a"), (0, "z"), (1, None)]
    got = ranks.with_row_id(spark.createDataFrame(rows, "x long, t string"), ["x", "t"]).collect()
    assert [(r["x"], r["t"]) for r in sorted(got, key=lambda r: r["row_id"])] == [
        (None, "b"), (0, "z"), (1, None), (1, "a"), (1, "a")
    ]
    assert sorted(r["row_id"] for r in got) == list(range(5))
