"""Run folders of both generations, broken files among them, and the report read back."""

import json

import pytest

from foldsafe import InferenceError, jobs
from foldsafe.operators import training
from foldsafe.sources import run_folders, runs

SUMMARY = {"model": "gbc", "metric": "auc", "direction": "maximize", "fold_scores": [0.5, 0.75], "score_mean": 0.625,
           "score_std": 0.125, "pipelines": ["a.joblib"]}


@pytest.fixture
def root(tmp_path):
    def put(run, name, text):
        (tmp_path / "art" / run).mkdir(parents=True, exist_ok=True)
        (tmp_path / "art" / run / name).write_bytes(text if isinstance(text, bytes) else text.encode())

    rows = "".join(f"{i},{i / 8}\n" for i in range(8))
    put("20240101-000000", "cv_summary.json", json.dumps(SUMMARY, indent=2))
    put("20240101-000000", "oof.csv", "PassengerId,oof\n" + rows)
    put("20240101-000000", "oof_eval.json", '{"metric": "accuracy", "value": 0.5, "n": 8, "run_dir": "x"}')
    put("20240102 a+b%", "cv_scores_ridge.json", "[0.25, null, 0.75]")
    put("20240102 a+b%", "cv_scores_abc.json", "[0.5]")
    put("20240102 a+b%", "oof.csv", "oof\n0.5\n")
    put("20240103", "cv_summary.json", '{"model": "x", broken')
    put("20240103", "oof_eval.json", "[1, 2]")
    put("20240103", "oof.csv", "PassengerId,oof,more\n1,0.5,2\n")
    put("20240104", "cv_summary.json", "")
    put("20240104", "report.md", "# Report")
    put("20240109", "cv_summary.json", "")
    put("20240105", "cv_summary.json", json.dumps(SUMMARY | {"score_mean": "high", "fold_scores": [float("nan")]}))
    put("20240105", "oof.csv", 'PassengerId,oof\n"7",\n9,much\n')
    put("20240106", "cv_summary.json", b"\xff\xfe\x00")
    put("20240106", "cv_scores_ridge.json", "[]")
    put("20240107", "report.md", "# Report")
    put("20240108/deeper", "cv_summary.json", json.dumps(SUMMARY))
    put("_unfinished", "cv_summary.json", json.dumps(SUMMARY))
    (tmp_path / "art" / "submissions_ledger.csv").write_text("a\n1\n")
    return str(tmp_path / "art")


def test_each_folder_is_a_run(spark, root):
    found = {r["run_id"]: r for r in run_folders.records(spark, root).collect()}
    assert sorted(found) == ["20240101-000000", "20240102 a+b%"] + [f"2024010{i}" for i in range(3, 8)]
    old, new = found["20240101-000000"], found["20240102 a+b%"]
    assert old["generation"] == "summary" and new["generation"] == "scores"
    assert old["summary"].asDict() | SUMMARY == old["summary"].asDict()
    assert old["evaluation"]["value"] == 0.5 and old["evaluation"]["n"] == 8
    # Equal means: the smaller name.
    assert new["summary"]["model"] == "abc" and new["summary"]["score_mean"] == 0.5
    for name in ("20240103", "20240104", "20240106", "20240107"):
        assert found[name]["summary"] is None and found[name]["generation"] is None
    assert found["20240103"]["evaluation"] is None
    # A field of another type is lost alone.
    assert found["20240105"]["summary"]["model"] == "gbc" and found["20240105"]["summary"]["score_mean"] is None
    assert runs.latest_id(run_folders.run_ids(spark, root)) == "20240107"


def test_scores_of_folds_without_a_score(spark, tmp_path):
    files = spark.createDataFrame([("r", "cv_scores_m.json", "[0.25, null, 0.75]")], "run_id string, file string, value string")
    assert run_folders.write_files(files, str(tmp_path / "w")) == 1
    made = run_folders.records(spark, str(tmp_path / "w")).first()["summary"]
    assert made["fold_scores"] == [0.25, None, 0.75] and (made["score_mean"], made["score_std"]) == (0.5, 0.25)


def test_oof_rows_of_all_runs(spark, root):
    rows = {(r["run_id"], r["PassengerId"]): r["oof"] for r in run_folders.read_oof(spark, root, "PassengerId").collect()}
    assert len(rows) == 10 and rows["20240101-000000", 3] == 3 / 8
    assert rows["20240105", 7] is None and rows["20240105", 9] is None


def test_large_oof_files_are_split(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "oof.csv").write_text("id,oof\n" + "".join(f"{i},0.5\n" for i in range(20000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        rows = run_folders.read_oof(spark, str(tmp_path), "id")
        assert rows.distinct().count() == rows.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_nothing_there(spark, tmp_path):
    assert run_folders.records(spark, str(tmp_path)).count() == 0
    assert run_folders.read_oof(spark, str(tmp_path), "id").dtypes == [("run_id", "string"), ("id", "bigint"), ("oof", "double")]
    with pytest.raises(InferenceError):
        runs.latest_id(run_folders.run_ids(spark, str(tmp_path)))


def test_import_into_a_store(spark, root, tmp_path):
    store = jobs.Store(spark, str(tmp_path / "store"), "PassengerId", "Survived")
    for _ in range(2):
        told = {r["run_id"]: r for r in jobs.import_runs(store, root).collect()}
    assert len(told) == 7 and told["20240101-000000"]["oof_accuracy"] == 0.5 and told["20240107"]["model"] is None
    known = {r["run_id"]: r for r in store.metrics().collect()}
    assert sorted(known) == ["20240101-000000", "20240102 a+b%", "20240105"]
    labels = spark.range(8).selectExpr("id AS PassengerId", "cast(id >= 4 AS int) AS Survived")
    assert jobs.eval_oof(store, labels, "20240101-000000").first()["value"] == 1.0
    assert store.metrics().filter("run_id = '20240101-000000'").first()["oof_accuracy"] == 1.0
    with pytest.raises(InferenceError):
        training.load_fold_models(spark, store.path, "20240101-000000")


def test_report_of_a_run(spark, tmp_path):
    store = jobs.Store(spark, str(tmp_path / "store"), "PassengerId", "Survived")
    saved = spark.createDataFrame(
        [("r1", "gbc", [0.123456, 1.0, None, float("nan")], 0.00001, '{"n": 2}', '{"log_fare": false, "bins": [1, 2]}', None)],
        "run_id string, model string, fold_scores array<double>, score_mean double, params string, features_cfg string, cv_cfg string",
    )
    runs.write_documents(saved, f"{store.path}/cv_summary")
    text = jobs.run_report(store, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report"), wholetext=True).first()[0].rstrip("\n") == text
    lines = text.split("\n")
    assert lines[0] == "# Model Training Report" and "**Run Directory:** r1" in lines
    assert "- Fold scores: [0.12346, 1.0, None, nan]" in lines and "- Mean CV score: 0.00001" in lines
    assert "- Parameters: `{\"n\": 2}`" in lines and "- log_fare: False" in lines and "- bins: [1,2]" in lines
    assert lines[-1] == "### cv"
    with pytest.raises(InferenceError):
        jobs.run_report(store, str(tmp_path / "none"), "r2")
