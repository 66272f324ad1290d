"""Run folders are listed from their root, whatever their number."""

from foldsafe.sources import run_folders


def test_run_folders_are_listed_from_the_root(spark, tmp_path):
    files = [(f"r{i}", "cv_scores_m.json", f"[0.{i}]") for i in range(1, 10)]
    made = spark.createDataFrame(files, "run_id string, file string, value string").coalesce(1)
    root = str(tmp_path / "runs")
    assert run_folders.write_files(made, root) == 9
    for deeper in ("r1/fold=0", "r1/more"):
        (tmp_path / "runs" / deeper).mkdir()
        (tmp_path / "runs" / deeper / "cv_scores_m.json").write_text("[0.99]")
    (tmp_path / "runs" / "cv_scores_m.json").write_text("[0.98]")
    notes = run_folders.notes(spark, root)
    assert "InMemoryFileIndex(1 paths)" in notes._jdf.queryExecution().toString()
    assert {tuple(r) for r in notes.collect()} == set(files)
    assert {tuple(r) for r in run_folders.notes(spark, f"file:{root}/").collect()} == set(files)
    assert {r["run_id"] for r in run_folders.run_ids(spark, root).collect()} == {f[0] for f in files}


def test_filters_that_drop_files_have_no_state(spark, tmp_path):
    # Scans that start at once evaluate them together on the driver; a pattern replacement there lost a file now and then.
    made = spark.createDataFrame([("r", "cv_scores_m.json", "[0.5]")], "run_id string, file string, value string")
    root = str(tmp_path / "runs")
    run_folders.write_files(made, root)
    for found in (run_folders.notes(spark, root), run_folders.run_ids(spark, root)):
        plan = found._jdf.queryExecution().analyzed().toString()
        assert "regexp_replace" not in plan and "lambda" not in plan
