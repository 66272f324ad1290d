"""The jobs one after another on one store, as a user runs them."""

import json

import pytest
from pyspark.sql import functions as F

from foldsafe import CVConfig, FeaturesConfig, InferenceError, ModelSpec, SchemaError, jobs
from foldsafe.sources import csv


def test_from_training_to_report(spark, tmp_path):
    df = spark.range(150).select(
        F.col("id").alias("PassengerId"),
        ((F.col("id") * 7 % 10) < 4).cast("int").alias("Survived"),
        (F.col("id") * 7 % 10 + F.col("id") % 3).cast("double").alias("Fare"),
        F.when(F.col("id") % 2 == 0, F.lit("male")).otherwise(F.lit("female")).alias("Sex"),
    )
    labels, test = df.select("PassengerId", "Survived"), df.drop("Survived")
    store = jobs.Store(spark, str(tmp_path / "store"), "PassengerId", "Survived", competition="demo")
    features = FeaturesConfig(log_fare=True)
    specs = [ModelSpec("logistic", {"max_iter": 10})]
    cv = CVConfig(scheme="stratified", n_splits=3)
    for name in ("20240101-000000", "20240102-000000"):
        jobs.train(store, df, cv, features, specs, run_id=name)
    assert store.run_id() == "20240102-000000"

    jobs.predict(store, test, str(tmp_path / "first"), threshold=0.5)
    first = csv.read(spark, str(tmp_path / "first"))
    assert first.columns == ["PassengerId", "Survived"] and first.count() == 150

    found = jobs.eval_oof(store, labels).first()
    assert found["n"] == 150 and 0.5 < found["value"] <= 1.0
    best = jobs.threshold_sweep(store, labels, str(tmp_path / "sweep")).first()
    assert best["accuracy"] >= found["value"]
    saved = json.loads(spark.read.text(str(tmp_path / "sweep" / "best_threshold")).first()[0])
    assert saved["best_threshold"] == best["best_threshold"]
    assert csv.read(spark, str(tmp_path / "sweep" / "oof_thresholds")).count() == 101

    both = ["20240101-000000", "20240102-000000"]
    merged = jobs.ensemble_predict(store, both, test, str(tmp_path / "both"), labels).collect()
    assert len(merged) == 150
    fixed = jobs.ensemble_predict(store, both, test, str(tmp_path / "fixed"), threshold=0.0)
    assert fixed.agg(F.min("Survived")).first()[0] == 1
    with pytest.raises(SchemaError):
        jobs.ensemble_predict(store, both, test, str(tmp_path / "none"))
    with pytest.raises(InferenceError):
        store.oof(["19990101-000000"])

    jobs.log_submission(store, "first.csv", 0.77, both[1], "x" * 90, 0.5, features, specs, cv)
    jobs.log_submission(store, "second.csv", 0.79, both[0], None, None, features, specs, cv)
    book = {r["file"]: r for r in store.ledger().collect()}
    assert book["first.csv"]["oof_accuracy"] == found["value"]
    assert book["second.csv"]["oof_accuracy"] is None and book["second.csv"]["oof_auc_mean"] > 0.5

    submitted = first.withColumn("file", F.lit("first.csv"))
    report = jobs.report_submissions(store, submitted, labels, str(tmp_path / "report"))
    rows = {r["file"]: r for r in report.collect()}
    assert rows["second.csv"]["oof_accuracy"] == pytest.approx(found["value"])
    assert rows["first.csv"]["pred_pos_rate"] is not None and rows["second.csv"]["pred_pos_rate"] is None
    jobs.report_markdown(store, report, str(tmp_path / "summary"))
    text = spark.read.text(str(tmp_path / "summary"), wholetext=True).first()[0]
    assert text.index("second.csv") < text.index("first.csv") and "log_fare=True" in text


def test_describe_is_written(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, t string")
    jobs.eda(df, str(tmp_path / "eda"))
    back = csv.read(spark, str(tmp_path / "eda"))
    assert {r["column"] for r in back.collect()} == {"n", "t"}
