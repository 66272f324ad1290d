"""Sources, sinks, ledger and report."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsafe import InferenceError
from foldsafe.functions import snapshot
from foldsafe.functions.text import ellipsis, first_filled
from foldsafe.operators import ledger
from foldsafe.sources import csv, runs, scratch


def test_csv_types_and_blanks(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(
        "whole,gaps,real,day,flag,text,void\n"
        '1,1,0.5,2020-01-01,True,"a, ""b""",\n'
        "2,NA,nan,2020-01-02,False,N/A,null\n"
        "-3,7,1e3,NaN,True,x,\n"
    )
    df = csv.read(spark, str(path))
    assert dict(df.dtypes) == {
        "whole": "bigint", "gaps": "double", "real": "double", "day": "string",
        "flag": "boolean", "text": "string", "void": "double",
    }
    rows = df.orderBy("whole").collect()
    assert [r["gaps"] for r in rows] == [7.0, 1.0, None]
    assert [r["real"] for r in rows] == [1000.0, 0.5, None]
    assert [r["text"] for r in rows] == ["x", 'a, "b"', None]
    assert [r["day"] for r in rows] == [None, "2020-01-01", "2020-01-02"]


def test_csv_with_schema_is_lazy_and_typed(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a,b\n1,x\nNA,y\nbad,z\n")
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    rows = csv.read(spark, str(tmp_path / "in.csv"), schema).orderBy("b").collect()
    assert [r["a"] for r in rows] == [1, None, None]


def test_csv_line_breaks(spark, tmp_path):
    (tmp_path / "in.csv").write_text('a,b\n1,"two\nlines"\n')
    assert csv.read(spark, str(tmp_path / "in.csv"), multiline=True).first()["b"] == "two\nlines"


def test_append_keeps_all_columns(spark, tmp_path):
    first = spark.createDataFrame([(1, "a")], "i int, old string")
    second = spark.createDataFrame([(2, "b")], "i int, new string")
    csv.append(first, None, str(tmp_path / "v1"))
    rows = csv.append(second, str(tmp_path / "v1"), str(tmp_path / "v2")).orderBy("i").collect()
    assert [tuple(r) for r in rows] == [(1, "a", None), (2, None, "b")]


def test_latest_run(spark):
    known = spark.createDataFrame([("20240101-000000",), ("20240102-000000",)], "run_id string")
    assert runs.latest_id(known) == "20240102-000000"
    with pytest.raises(InferenceError):
        runs.latest_id(known.limit(0))


def test_shared_folder_is_reused(spark):
    assert scratch.shared_root(spark) == scratch.shared_root(spark)
    assert scratch.new_path(spark, "x") != scratch.new_path(spark, "x")


def test_json_helpers(spark):
    texts = ['{"log_fare": true, "add_title": false, "other": 1}', "{}", "[1]", "{bad", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    got = [r[0] for r in df.select(snapshot.flag_summary(F.col("t"))).collect()]
    assert got == ["add_title=False, log_fare=True", "", None, None, None, None]
    names = spark.createDataFrame([('[{"name": "a"}, {"name": "b"}]',), ("[]",), ("no",)], "t string")
    assert [r[0] for r in names.select(snapshot.first_model(F.col("t"))).collect()] == ["a", None, None]


def test_text_helpers(spark):
    df = spark.createDataFrame([("x" * 81, "", "b"), ("x" * 80, None, None)], "m string, a string, b string")
    rows = df.select(ellipsis(F.col("m")).alias("m"), first_filled(F.col("a"), F.col("b")).alias("f")).collect()
    assert rows[0]["m"] == "x" * 77 + "..." and rows[1]["m"] == "x" * 80
    assert [r["f"] for r in rows] == ["b", None]


@pytest.fixture(scope="module")
def metrics_table(spark):
    return spark.createDataFrame(
        [("r1", "logistic", "auc", [0.7, 0.9], 0.8, 0.1, 0.75), ("r2", "ridge", "rmse", [1.0], 1.0, 0.0, None)],
        "run_id string, model string, metric string, fold_scores array<double>, score_mean double, "
        "score_std double, oof_accuracy double",
    )


def _entries(spark):
    rows = [
        ("2024-01-01 10:00:00", "c", "a.csv", "first", "r1", None, 0.7, json.dumps({"log_fare": True})),
        ("2024-01-02 10:00:00", "c", "b.csv", "", "r2", 0.25, 0.9, "{bad"),
        ("2024-01-03 10:00:00", "c", "a.csv", "long " * 30, None, 0.5, None, json.dumps({"log_fare": False})),
    ]
    df = spark.createDataFrame(
        rows,
        "timestamp string, competition string, file string, message string, run_id string, "
        "threshold double, leaderboard_score double, features_cfg string",
    )
    return df.withColumn("models_cfg", F.lit('[{"name": "logistic"}]')).withColumn("cv_cfg", F.lit("{}"))


def test_ledger_from_entry_to_summary(spark, metrics_table, tmp_path):
    path = str(tmp_path / "ledger")
    ledger.append(ledger.record(_entries(spark), metrics_table), path)
    book = ledger.read(spark, path)
    by_file = {(r["file"], r["timestamp"][:10]): r for r in book.collect()}
    assert by_file["a.csv", "2024-01-01"]["oof_auc_mean"] == 0.8
    assert by_file["a.csv", "2024-01-01"]["oof_accuracy"] == 0.75
    assert by_file["b.csv", "2024-01-02"]["oof_auc_mean"] is None
    assert by_file["b.csv", "2024-01-02"]["cv_model"] == "ridge"

    submitted = spark.createDataFrame([("a.csv", 1, 1), ("a.csv", 2, 0), ("a.csv", 3, None)], "file string, i int, label int")
    oof = spark.createDataFrame(
        [("r2", 1, 0.25), ("r2", 2, 0.24), ("r2", 3, 0.9), ("r2", 4, None), ("r1", 1, 0.1)],
        "run_id string, i int, oof double",
    )
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "i int, y int")
    report = ledger.report(book, metrics_table, submitted, oof, labels, "i", "y")
    got = {(r["file"], r["timestamp"][:10]): r for r in report.collect()}
    assert len(got) == 3
    assert got["a.csv", "2024-01-01"]["pred_pos_rate"] == pytest.approx(1 / 3)
    assert got["a.csv", "2024-01-01"]["cv_fold_scores"] == "[0.7,0.9]"
    # Known in the ledger: kept. Missing with a run: computed at the entry's threshold.
    assert got["a.csv", "2024-01-01"]["oof_accuracy"] == 0.75
    assert got["b.csv", "2024-01-02"]["oof_accuracy"] == pytest.approx(0.5)
    assert got["a.csv", "2024-01-03"]["oof_accuracy"] is None

    top = ledger.topk(report, book, 5)
    rows = {(r["ranking"], r["rank"]): r for r in top.collect()}
    assert [rows["leaderboard", i]["file"] for i in (1, 2)] == ["b.csv", "a.csv"]
    assert ("leaderboard", 3) not in rows
    # Settings come from the last entry of the file.
    assert rows["leaderboard", 2]["features"] == "log_fare=False"
    assert rows["leaderboard", 1]["features"] is None and rows["leaderboard", 1]["note"] is None
    texts = [r["text"] for r in ledger.lines(top).collect()]
    assert texts[0].startswith("- 2024-01-02 10:00:00: model=ridge, thr=0.25")
    ledger.write_markdown(top, str(tmp_path / "summary"))
    written = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "summary"), wholetext=True).collect())
    assert written.index("## Top by Leaderboard Score") < written.index("## Top by OOF Accuracy")


def test_accuracy_at_many_thresholds(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    p, y = np.round(rng.random(500), 2), rng.integers(0, 2, 500)
    run = np.where(np.arange(500) % 3 == 0, "hot", "cold")
    scored = spark.createDataFrame(
        [(str(r), float(a), int(b)) for r, a, b in zip(run, p, y)], "run_id string, oof double, y int"
    )
    marks = spark.createDataFrame(
        [(r, float(t)) for r in ("hot", "cold", "none") for t in np.linspace(-0.1, 1.1, 61)],
        "run_id string, threshold double",
    )
    got = {(r["run_id"], r["threshold"]): r["accuracy"] for r in ledger.accuracy_at(scored, marks, "y", "oof").collect()}
    assert len(got) == 122
    for (name, t), accuracy in got.items():
        mine = run == name
        assert accuracy == pytest.approx((((p >= t).astype(int) == y)[mine]).mean())
