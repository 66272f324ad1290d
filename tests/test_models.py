"""Models against closed forms, saved models, fallbacks and typed errors."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import functions as F

from foldsafe import CVConfig, FeatureColumns, FeaturesConfig, InferenceError, MetricError, ModelSpec, SchemaError, TrainingError
from foldsafe.operators import models, preprocess, scoring, stages, training

RNG = np.random.default_rng(3)
N = 240


@pytest.fixture(scope="module")
def data():
    x = RNG.normal(0, [1.0, 5.0], (N, 2))
    odds = 1 / (1 + np.exp(-(0.8 * x[:, 0] - 0.2 * x[:, 1])))
    y = (RNG.random(N) < odds).astype(float)
    return x, y, 2 + x @ np.array([1.5, -0.5]) + RNG.normal(0, 0.3, N)


@pytest.fixture(scope="module")
def table(spark, data):
    x, y, z = data
    rows = [
        (i, float(a), float(b), "even" if i % 2 == 0 else "odd", int(c), float(d))
        for i, ((a, b), c, d) in enumerate(zip(x, y, z))
    ]
    return spark.createDataFrame(
        rows, "row_id long, a double, b double, kind string, y int, z double"
    ).persist()


def _standard(x):
    return (x - x.mean(0)) / x.std(0)


def _newton(x, y, c):
    """Penalised logistic regression, intercept free."""
    design = np.c_[x, np.ones(len(x))]
    w = np.zeros(design.shape[1])
    penalty = np.diag([1.0 / c] * x.shape[1] + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ w))
        slope = design.T @ (p - y) + penalty @ w
        curve = (design * (p * (1 - p))[:, None]).T @ design + penalty
        w -= np.linalg.solve(curve, slope)
    return w


def test_logistic_equals_newton(table, data):
    x, y, _ = data
    model = models.make("logistic", "binary", {"C": 0.5, "tol": 1e-12}, N)
    pipeline, _, _ = preprocess.build_pipeline(
        table.schema, "y", "row_id", FeaturesConfig(drop_cols=("z", "kind")), model
    )
    fitted = pipeline.fit(table.withColumn("label", F.col("y").cast("double"))).stages[-1]
    want = _newton(_standard(x), y, 0.5)
    assert np.allclose([*fitted.coefficients, fitted.intercept], want, atol=1e-5)


def test_ridge_equals_closed_form(table, data):
    x, _, z = data
    model = models.make("ridge", "regression", {"alpha": 7.0}, N, float(z.std()))
    pipeline, _, _ = preprocess.build_pipeline(
        table.schema, "z", "row_id", FeaturesConfig(drop_cols=("y", "kind")), model
    )
    fitted = pipeline.fit(table.withColumn("label", F.col("z"))).stages[-1]
    s = _standard(x)
    want = np.linalg.solve(s.T @ s + 7.0 * np.eye(2), s.T @ (z - z.mean()))
    assert np.allclose(fitted.coefficients, want, atol=1e-8)


@pytest.fixture(scope="module")
def run(table):
    return training.cross_fit(
        table.drop("z"),
        CVConfig(scheme="stratified", n_splits=3),
        FeaturesConfig(),
        [ModelSpec("logistic", {"max_iter": 50}), ModelSpec("gbc", {"n_estimators": 2})],
        id_col="row_id",
        target="y",
        run_id="20240101-120000",
    )


def test_out_of_fold_rows(run, table):
    rows = run.best_oof().select("row_id").collect()
    assert sorted(r["row_id"] for r in rows) == list(range(N))
    assert set(run.scores) == {"logistic", "gbc"} and len(run.scores["logistic"]) == 3
    assert run.best == max(run.scores, key=lambda m: np.mean(run.scores[m]))


def test_fold_model_saw_only_its_training_rows(run, table, data):
    """The first fold's logistic equals Newton on the other folds' rows alone."""
    x, y, _ = data
    folds = {r["row_id"]: r["fold"] for r in run.best_oof().select("row_id", "fold").collect()}
    train = np.array([folds[i] != 0 for i in range(N)])
    own = table.filter(F.col("row_id").isin([i for i in range(N) if folds[i] == 0])).drop("y", "z")
    got = {
        r["row_id"]: r["p"] for r in scoring.fold_average([run.models["logistic"][0]], own).collect()
    }
    kind = (np.arange(N) % 2 == 0).astype(float)
    s = (x - x[train].mean(0)) / x[train].std(0)
    design = np.c_[s, kind, 1 - kind]
    w = _newton(design[train], y[train], 1.0)
    want = 1 / (1 + np.exp(-np.c_[design, np.ones(N)] @ w))
    assert np.allclose([got[i] for i in sorted(got)], want[~train], atol=1e-3)


def test_summary_row(run):
    row = run.summary().first()
    assert row["run_id"] == "20240101-120000" and row["metric"] == "auc"
    assert row["score_mean"] == pytest.approx(np.mean(row["fold_scores"]))
    assert row["score_std"] == pytest.approx(np.std(row["fold_scores"]))


def test_saved_run_scores_the_same(spark, run, table, tmp_path):
    run.save(str(tmp_path))
    loaded = training.load_fold_models(spark, str(tmp_path))
    test = table.drop("y", "z")
    want = {r["row_id"]: r["p"] for r in scoring.fold_average(run.fold_models, test).collect()}
    got = {r["row_id"]: r["p"] for r in scoring.fold_average(loaded, test).collect()}
    assert got == pytest.approx(want)
    oof = spark.read.parquet(str(tmp_path / "oof"))
    assert {"run_id", "model"} <= set(oof.columns) and oof.count() == 2 * N


def test_fold_average_is_the_mean(run, table):
    test = table.drop("y", "z")
    single = [
        {r["row_id"]: r["p"] for r in scoring.fold_average([m], test).collect()} for m in run.fold_models
    ]
    for r in scoring.fold_average(run.fold_models, test).collect():
        assert r["p"] == pytest.approx(np.mean([s[r["row_id"]] for s in single]))


def test_scoring_does_not_shuffle_the_table(run, table):
    plan = scoring.fold_average(run.fold_models, table.drop("y", "z"))._jdf.queryExecution()
    assert "Exchange hash" not in plan.executedPlan().toString()


def test_runs_are_averaged_in_one_narrow_pass(run, table):
    """Every model of every run as columns: no shuffle, one scan, and repeated ids keep a row each."""
    test = table.drop("y", "z")
    runs = {"all": run.fold_models, "first": run.fold_models[:1]}
    plan = scoring.run_average(runs, test)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and plan.count("Scan ") <= test._jdf.queryExecution().executedPlan().toString().count("Scan ")
    each = [{r["row_id"]: r["p"] for r in scoring.fold_average(m, test).collect()} for m in runs.values()]
    twice = test.union(test.limit(5)).withColumn("p", F.lit("own"))
    got = scoring.run_average(runs, twice).collect()
    assert len(got) == N + 5 and got[0].__fields__.count("p") == 1
    for r in got:
        assert r["p"] == pytest.approx((each[0][r["row_id"]] + each[1][r["row_id"]]) / 2)
    with pytest.raises(InferenceError):
        scoring.run_average({}, test)


class _Fake(Transformer):
    """A model that gives only the named outputs."""

    def __init__(self, **columns):
        super().__init__()
        self.columns = columns

    def _transform(self, df):
        return df.withColumns(self.columns)


def test_scores_fall_back(spark):
    from pyspark.ml.functions import array_to_vector

    df = spark.range(2).withColumnRenamed("id", "row_id")
    margin = _Fake(rawPrediction=array_to_vector(F.array(F.lit(-1.0), F.lit(1.0))), prediction=F.lit(1.0))
    got = scoring.fold_average([margin], df).first()["p"]
    assert got == pytest.approx(1 / (1 + np.exp(-1.0)))
    ones, zeros = _Fake(prediction=F.lit(1.0)), _Fake(prediction=F.lit(0.0))
    assert scoring.fold_average([ones, zeros], df).first()["p"] == 1.0
    assert scoring.fold_average([ones, zeros, zeros], df).first()["p"] == 0.0
    # Votes are left out where any model has a score.
    assert scoring.fold_average([margin, zeros], df).first()["p"] == pytest.approx(got)


def test_feature_order_and_unseen_levels(spark):
    df = spark.createDataFrame(
        [(1, 2.0, "b", None), (2, None, "a", 5), (3, 4.0, None, 5)], "row_id long, x double, t string, n int"
    )
    prep = preprocess.learn(df.withColumn("fold", F.lit(-1)), FeaturesConfig(scale_numeric=False), 1, "kfold", ["row_id"])[0]
    assert preprocess.feature_names(prep) == ["n", "x", "t=a", "t=b"]
    out = {r["row_id"]: list(r["features"]) for r in prep.transform(df).collect()}
    assert out == {1: [5.0, 2.0, 0.0, 1.0], 2: [5.0, 3.0, 1.0, 0.0], 3: [5.0, 4.0, 1.0, 0.0]}
    new = spark.createDataFrame([(9, 1.0, "zz", 1)], df.schema)
    assert list(prep.transform(new).first()["features"]) == [1.0, 1.0, 0.0, 0.0]


def test_engineered_features_in_a_pipeline(spark):
    rows = [(i, f"Doe, {'Mr' if i % 3 else 'Dr'}. X", i % 2, 0, f"t{i % 4}", float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "row_id long, who string, sibs int, kids int, ticket string, fare double")
    cfg = FeaturesConfig(
        add_family=True,
        add_is_alone=True,
        add_title=True,
        add_deck=True,
        add_ticket_group_size=True,
        log_fare=True,
        bin_age=True,
        rare_title_threshold=5,
        scale_numeric=False,
        columns=FeatureColumns(siblings="sibs", parents="kids", name="who", ticket="ticket", fare="fare"),
        drop_cols=("who", "ticket"),
    )
    prep = preprocess.learn(df.withColumn("fold", F.lit(-1)), cfg, 1, "kfold", ["row_id"])[0]
    # Deck and age class need columns the table does not have: they are not announced.
    assert preprocess.feature_names(prep) == [
        "FamilySize", "IsAlone", "LogFare", "TicketGroupSize", "fare", "kids", "sibs", "Title=Mr", "Title=Rare",
    ]
    first = list(prep.transform(df.filter("row_id = 0")).first()["features"])
    assert first == [1.0, 1.0, 0.0, 3.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def test_count_tables_are_saved_with_the_stage(spark, tmp_path):
    rows = [(i, f"Doe, {'Mr' if i % 3 else 'Dr'}. X", f"t{i % 4}") for i in range(12)]
    df = spark.createDataFrame(rows, "row_id long, Name string, Ticket string")
    cfg = FeaturesConfig(add_title=True, add_ticket_group_size=True, rare_title_threshold=5, drop_cols=("Name", "Ticket"))
    prep = preprocess.learn(df.withColumn("fold", F.lit(-1)), cfg, 1, "kfold", ["row_id"])[0]
    prep.save(str(tmp_path / "prep"))
    loaded = PipelineModel.load(str(tmp_path / "prep"))
    new = df.unionByName(spark.createDataFrame([(99, "no comma", "unseen")], df.schema))
    want = {r["row_id"]: r["features"] for r in prep.transform(new).collect()}
    assert {r["row_id"]: r["features"] for r in loaded.transform(new).collect()} == want
    assert list(want[99]) == [(1 - 3) / 1.0, 0.0, 0.0]


def test_text_can_be_left_out(table):
    numbers, texts = preprocess.feature_columns(
        table.schema, FeaturesConfig(encode_categorical=False), ["row_id", "y"]
    )
    assert (numbers, texts) == (["a", "b", "z"], [])


def test_many_levels_as_a_table_give_the_same_features(spark, monkeypatch, tmp_path):
    df = spark.range(40).select(
        F.col("id").alias("row_id"),
        F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("t"),
        F.when(F.col("id") % 3 > 0, (F.col("id") % 2).cast("string")).alias("u"),
        (F.col("id") % 4).cast("int").alias("fold"),
    )
    asked = df.unionByName(spark.createDataFrame([(99, "new", None, 0)], df.schema))

    def features(preps):
        return [sorted((r["row_id"], list(r["features"])) for r in p.transform(asked).collect()) for p in preps]

    listed = preprocess.learn(df, FeaturesConfig(), 4, "kfold", ["row_id"])
    want, names = features(listed), preprocess.feature_names(listed[0])
    monkeypatch.setattr(preprocess, "_MANY_LEVELS", 3)
    tabled = preprocess.learn(df, FeaturesConfig(), 4, "kfold", ["row_id"])
    assert any(isinstance(s, stages.LevelModel) for s in tabled[0].stages)
    assert features(tabled) == want and preprocess.feature_names(tabled[0]) == names
    tabled[0].write().save(str(tmp_path / "m"))
    assert features([PipelineModel.load(str(tmp_path / "m"))]) == want[:1]


@pytest.mark.parametrize("name", ["rf", "RandomForest", "gbc", "hist_gradient_boosting", "xgb", "catboost"])
@pytest.mark.parametrize("task", ["binary", "regression"])
def test_every_name_has_both_tasks(spark, name, task):
    kind = type(models.make(name, task)).__name__
    assert kind.endswith("Classifier" if task == "binary" else "Regressor")


def test_model_errors(spark):
    for name in ("lgbm", "nothing"):
        with pytest.raises(TrainingError):
            models.make(name, "binary")
    with pytest.raises(TrainingError):
        models.make("gbc", "binary", {"no_such": 1})
    with pytest.raises(MetricError):
        models.make("gbc", "multiclass")
    with pytest.raises(TrainingError):
        models.make("logistic", "regression")


def test_one_class_fold_has_no_score(spark):
    df = spark.range(40).select(
        F.col("id").alias("row_id"),
        (F.col("id") * 3 % 7).cast("double").alias("x"),
        (F.col("id") % 2).cast("int").alias("y"),
        F.col("id").alias("t"),
    )
    late = df.withColumn("y", F.when(F.col("t") >= 30, 1).otherwise(F.col("y")))
    run = training.cross_fit(
        late,
        CVConfig(scheme="timeseries", n_splits=3, time_column="t"),
        FeaturesConfig(drop_cols=("t",)),
        [ModelSpec("logistic", {"max_iter": 5})],
        id_col="row_id",
        target="y",
    )
    assert run.scores["logistic"][2] is None and None not in run.scores["logistic"][:2]
    # Rows before the first block are never held out.
    assert run.oof.count() == 30


def test_refit_uses_all_rows(run, table):
    whole = training.refit(run, table.drop("z"))
    assert isinstance(whole, PipelineModel)
    labels = scoring.predict_best(whole, table.drop("z", "y"), "row_id", "y")
    assert labels.count() == N and {r["y"] for r in labels.collect()} <= {0, 1}
