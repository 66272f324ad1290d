"""Statistics, metrics and thresholds against numpy."""

import math

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from foldsafe import FeaturesConfig, InferenceError, MetricError, SchemaError
from foldsafe.functions import numeric, text
from foldsafe.operators import (
    contracts,
    ensemble,
    features,
    joins,
    loo,
    metrics,
    profile,
    quantiles,
    thresholds,
)

RNG = np.random.default_rng(7)


@pytest.fixture(scope="module")
def values():
    """Heavy ties, negative numbers, wide range."""
    x = np.concatenate([np.full(700, 3.25), RNG.normal(0, 1e6, 900), RNG.integers(-5, 5, 400).astype(float)])
    RNG.shuffle(x)
    return x


@pytest.fixture(scope="module")
def table(spark, values):
    rows = [(i, float(v), i % 2) for i, v in enumerate(values)]
    rows += [(10_000 + i, None, 0) for i in range(50)] + [(20_000, float("nan"), 1)]
    return spark.createDataFrame(rows, "row_id long, x double, g int").persist()


@pytest.mark.parametrize("small", [10**6, 20])
def test_exact_quantiles(table, values, small):
    probabilities = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    column = quantiles.exact(table, {"x": F.col("x")}, probabilities, small)["x"]
    got = table.agg(column.alias("q")).first()["q"]
    assert np.allclose(got, np.quantile(values, probabilities), rtol=1e-12)


def test_select_by_narrowing(table, values, monkeypatch):
    monkeypatch.setattr(quantiles, "_ACCURACY", 50)
    places = [0, 1, 17, 500, 1000, 1500, 1998, 1999]
    got = quantiles.select(table, {"x": F.col("x")}, [("x", p) for p in places], settle_rows=3)
    assert [got["x", p] for p in places] == [float(v) for v in np.sort(values)[places]]


def test_kth_largest(table, values):
    for k in (1, 700, 2000):
        assert quantiles.kth_largest(table, "x", k) == np.sort(values)[-k]


@pytest.mark.parametrize("small", [10**6, 30])
def test_medians_per_holdout(table, values, small):
    folded = table.withColumn("fold", (F.col("row_id") % 3).cast("int"))
    got = {r["holdout"]: r["fill"] for r in loo.medians(folded, ["x"], 3, "kfold", small).collect()}
    folds = np.arange(len(values)) % 3
    for h in range(3):
        assert got[h] == pytest.approx(np.median(values[folds != h]), rel=1e-12)


def test_time_folds_learn_from_earlier_rows_only(table, values):
    folded = table.filter("x is not null and not isnan(x)").withColumn(
        "fold", (F.col("row_id") / 500).cast("int") - 1
    )
    stats = {
        r["holdout"]: r for r in loo.numeric_stats(folded, ["x"], 3, "mean", "timeseries").collect()
    }
    for h in range(3):
        train = values[: 500 * (h + 1)]
        assert stats[h]["n"] == len(train)
        assert stats[h]["mean"] == pytest.approx(train.mean(), rel=1e-9)
        assert stats[h]["sd"] == pytest.approx(train.std(), rel=1e-9)


def test_constant_and_empty_columns(spark):
    df = spark.range(90).select(
        F.col("id").alias("row_id"),
        (F.col("id") % 3).cast("int").alias("fold"),
        F.lit(0.1).alias("same"),
        F.lit(None).cast("double").alias("empty"),
    )
    for r in loo.numeric_stats(df, ["same", "empty"], 3).collect():
        assert r["sd"] == 1.0
        assert r["fill"] == (pytest.approx(0.1) if r["column"] == "same" else 0.0)
    stats = loo.numeric_stats(df, ["same", "empty"], 3)
    out = loo.impute_scale(df, ["same", "empty"], stats).select("same", "empty").distinct().collect()
    assert all(abs(v) < 1e-9 for r in out for v in r)


@pytest.mark.parametrize("strategy", ["median", "mean", "most_frequent", "constant"])
def test_imputation_strategies(table, values, strategy):
    folded = table.withColumn("fold", F.lit(-1))
    got = loo.numeric_stats(folded, ["x"], 1, strategy, "kfold").first()
    found, times = np.unique(values, return_counts=True)
    want = {
        "median": np.median(values),
        "mean": values.mean(),
        "most_frequent": found[times.argmax()],
        "constant": 0.0,
    }[strategy]
    assert got["fill"] == pytest.approx(want, rel=1e-9)
    filled = np.concatenate([values, np.full(51, got["fill"])])
    assert got["mean"] == pytest.approx(filled.mean(), rel=1e-9)
    assert got["sd"] == pytest.approx(filled.std(), rel=1e-9)


def test_held_out_rows_do_not_leak(spark, folder):
    """Changing a fold's own rows leaves what it may use unchanged."""
    base = spark.range(200).select(
        F.col("id").alias("row_id"),
        (F.col("id") % 4).cast("int").alias("fold"),
        (F.col("id") * 37 % 101).cast("double").alias("fare"),
        F.concat(F.lit("T"), (F.col("id") % 9).cast("string")).alias("ticket"),
    )
    held = F.col("fold") == 2
    changed = base.withColumn("fare", F.when(held, -1e9).otherwise(F.col("fare"))).withColumn(
        "ticket", F.when(held, F.lit("other")).otherwise(F.col("ticket"))
    )

    def learnt(df):
        stats = loo.numeric_stats(df, ["fare"], 4).filter("holdout = 2").collect()
        levels = loo.level_counts(df, ["ticket"], 4, "kfold").filter("holdout = 2").collect()
        return stats, sorted(levels)

    assert learnt(base) == learnt(changed)


def test_unseen_and_rare_levels(spark):
    rows = [(1, 0, "Doe, Mr. A", "x"), (2, 1, "Doe, Mr. B", "y"), (3, 2, "Roe, Dr. C", "x"), (4, 2, None, "x")]
    df = spark.createDataFrame(rows, "row_id long, fold int, Name string, kind string")
    cfg = FeaturesConfig(add_title=True, rare_title_threshold=2)
    got = {r["row_id"]: r["Title"] for r in features.leave_fold_out(df, cfg, 3).collect()}
    # Seen once in training: rare. Not seen in training at all: kept.
    assert got == {1: "Rare", 2: "Rare", 3: "Dr", 4: "Unknown"}
    hot = {r["row_id"]: r["hot"] for r in loo.one_hot(df, "row_id", ["kind"], 3).collect()}
    assert hot == {1: 1, 2: 0, 3: 1, 4: 1}


def test_titles(spark):
    names = ["Doe, Mr. John", "Smith, the Countess. of X", "no comma", None, "A, Mlle. B", "X, Ms. Y", "Q, . Z"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [r[0] for r in df.orderBy("i").select(text.normal_title(F.col("n"))).collect()]
    assert got == ["Mr", "the Countess", "Unknown", "Unknown", "Miss", "Miss", ""]


def test_age_bins(spark):
    ages = [0.0, 0.5, 5.0, 5.1, 80.0, 81.0, None, float("nan")]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ages)], "i int, a double").orderBy("i")
    got = [r[0] for r in df.select(numeric.age_bin(F.col("a"))).collect()]
    assert got == ["nan", "(0, 5]", "(0, 5]", "(5, 12]", "(60, 80]", "nan", "nan", "nan"]
    low = [r[0] for r in df.select(numeric.right_closed_bin(F.col("a"), numeric.AGE_EDGES, True)).collect()]
    assert low[0] == "(-0.001, 5.0]" and low[5] is None


def test_decks(spark):
    df = spark.createDataFrame([("C85",), ("Z1",), ("",), (None,), ("T",)], "c string")
    assert [r[0] for r in df.select(text.deck(F.col("c"))).collect()] == ["C", "U", "U", "U", "T"]


@pytest.fixture(scope="module")
def scored(spark):
    n = 3000
    y = (RNG.random(n) < 0.3).astype(int)
    p = np.clip(np.round(RNG.normal(0.4 + 0.2 * y, 0.2), 2), 0, 1)
    p[:1000] = 0.5
    rows = [(i, int(a), float(b), f"m{i % 2}") for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "row_id long, y int, p double, model string").persist()


def test_auc_equals_the_evaluator(scored):
    own = metrics.auc(scored, "y", "p").first()["auc"]
    double = scored.withColumn("y", F.col("y").cast("double"))
    other = BinaryClassificationEvaluator(
        rawPredictionCol="p", labelCol="y", metricName="areaUnderROC", numBins=0
    ).evaluate(double)
    assert own == pytest.approx(other, abs=1e-12)
    by_model = metrics.auc(scored, "y", "p", ["model"]).collect()
    for row in by_model:
        part = double.filter(F.col("model") == row["model"])
        want = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="y", numBins=0).evaluate(part)
        assert row["auc"] == pytest.approx(want, abs=1e-12)


def test_auc_edge_cases(spark):
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5)], "y int, p double")
    assert metrics.auc(tied, "y", "p").first()["auc"] == 0.5
    one_class = spark.createDataFrame([(1, 0.1), (1, 0.9)], "y int, p double")
    assert metrics.auc(one_class, "y", "p").first()["auc"] is None


def test_sweep_against_brute_force(scored):
    rows = scored.select("y", "p").collect()
    y, p = np.array([r["y"] for r in rows]), np.array([r["p"] for r in rows])
    points = np.arange(0.0, 1.0 + 1e-9, 0.01)
    assert thresholds.grid() == [float(t) for t in points]
    got = thresholds.sweep(scored, "y", "p").collect()
    want = [float(((p >= t).astype(int) == y).mean()) for t in points]
    assert [r["accuracy"] for r in got] == pytest.approx(want)
    assert got[0]["accuracy"] == pytest.approx(y.mean())
    best = thresholds.best(thresholds.sweep(scored, "y", "p")).first()
    assert best["best_threshold"] == points[int(np.argmax(want))]


def test_missing_score_never_passes(spark):
    df = spark.createDataFrame([(1, None), (0, float("nan")), (1, 0.9)], "y int, p double")
    assert [r["label"] for r in thresholds.apply(df, "p", 0.0).collect()] == [0, 0, 1]
    assert thresholds.sweep(df, "y", "p", 0.0, 0.0, 0.5).first()["accuracy"] == pytest.approx(2 / 3)


@pytest.mark.parametrize("ones", [0.0, 0.37, 1.0])
def test_prevalence_cut(spark, scored, ones):
    n = scored.count()
    labels = spark.range(n).select((F.col("id") < round(ones * n)).cast("int").alias("y"))
    cut = thresholds.prevalence_cut(scored, "p", labels, "y")
    p = np.sort([r["p"] for r in scored.select("p").collect()])
    k = int(round(n * ones))
    assert cut.k == k
    assert cut.threshold == (1.0 if k == 0 else p[-k])


def test_ensembles(spark):
    wide = spark.createDataFrame([(1, 0.25, 0.75), (2, 1.0, 0.5)], "row_id long, a double, b double")
    long = wide.unpivot(["row_id"], ["a", "b"], "source", "p")
    mean = {r["row_id"]: r["p"] for r in ensemble.mean(long, "row_id").collect()}
    same = {r["row_id"]: r["p"] for r in ensemble.weighted(long, {"a": 1.0, "b": 1.0}, "row_id").collect()}
    assert mean == same == {1: 0.5, 2: 0.75}
    one = {r["row_id"]: r["p"] for r in ensemble.weighted(long, {"a": 3.0, "b": 1.0}, "row_id").collect()}
    assert one == {1: 0.375, 2: 0.875}
    votes = thresholds.apply(long, "p", 0.6)
    assert {r["row_id"]: r["label"] for r in ensemble.vote(votes, "row_id").collect()} == {1: 1, 2: 1}
    with pytest.raises(InferenceError):
        ensemble.weighted(long, {"a": 1.0}, "row_id")
    with pytest.raises(InferenceError):
        ensemble.stack({}, "row_id", "p")


def test_hot_key_lookup(spark):
    df = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k")
    )
    counts = df.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k <> '7'")
    for rows in (None, 10, 10**9):
        got = joins.lookup(df, F.col("k"), counts, "k", ["n"], "n", rows).collect()
        assert len(got) == 3000
        for r in got:
            assert r["n"] == (1000 if r["k"] == "hot" else None if r["k"] == "7" else 1)


def test_profile_edges(spark):
    df = spark.createDataFrame(
        [(1, None, None), (2, None, "b"), (3, None, "a")], "n int, empty double, t string"
    )
    got = {r["column"]: r for r in profile.describe_all(df).collect()}
    assert got["empty"]["count"] == 0 and got["empty"]["mean"] is None
    assert (got["t"]["top"], got["t"]["freq"], got["t"]["unique"]) == ("a", 1, 2)
    assert [r["column"] for r in profile.missingness(df).collect()] == ["empty", "t"]
    same = df.withColumn("n", F.lit(4))
    bins = profile.histogram(same, "n", 3).collect()
    assert [r["count"] for r in bins] == [3, 0, 0]


def test_contracts(spark):
    train = spark.createDataFrame([(1, 0), (1, 1), (2, None), (3, 5)], "id long, y int")
    oof = spark.createDataFrame([(1, 0.2), (9, 1.4), (3, None)], "id long, oof double")
    found = {r["finding"]: (r["rows"], r["ok"]) for r in contracts.report(train, "id", "y", oof).collect()}
    assert found["repeated train ids"] == (1, False)
    assert found["train ids without oof"] == (1, False)
    assert found["oof ids without label"] == (1, False)
    assert found["targets not 0 or 1"] == (1, False)
    assert found["scores outside 0 to 1"] == (1, False)
    with pytest.raises(SchemaError):
        contracts.require_columns(train, ["nope"])
    with pytest.raises(InferenceError):
        contracts.require_binary("regression")
    with pytest.raises(InferenceError):
        contracts.require_threshold(1.5)


def test_metric_registry():
    assert metrics.get("binary", "auc").direction is metrics.Direction.MAXIMIZE
    assert metrics.get("regression", "unknown").name == "rmse"
    with pytest.raises(MetricError):
        metrics.get("multiclass", "auc")


def test_summary_direction(spark):
    scores = spark.createDataFrame(
        [("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 1.5), ("b", 1, 1.5)], "model string, fold int, score double"
    )
    summary = metrics.fold_summary(scores)
    assert metrics.best_model(summary, metrics.Direction.MAXIMIZE).first()["model"] == "a"
    assert metrics.best_model(summary, metrics.Direction.MINIMIZE).first()["model"] == "b"
    a = summary.filter("model = 'a'").first()
    assert a["fold_scores"] == [1.0, 3.0] and a["score_std"] == 1.0 and math.isclose(a["score_mean"], 2.0)


