"""Forests grown for all folds together: their trees, their jobs and what is kept of them."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from foldsafe.config import CVConfig, FeaturesConfig, ModelSpec
from foldsafe.errors import TrainingError
from foldsafe.operators import boosting, fitted, forest, models, training
from foldsafe.operators.forest import Settings

LANES = "lane int, key long, label double, features array<double>"


def rows(n, seed, task="binary"):
    rng = np.random.default_rng(seed)
    x = np.column_stack((rng.integers(0, 12, n), rng.integers(0, 3, n), rng.integers(0, 20, n))).astype(float)
    y = (x[:, 0] + 3 * x[:, 1] + rng.normal(0, 4, n) > 9).astype(float)
    return x, y if task == "binary" else y * 3 + x[:, 2]


def lanes(spark, by_lane):
    return spark.createDataFrame(
        [(lane, i, float(y[i]), x[i].tolist()) for lane, (x, y) in by_lane.items() for i in range(len(y))], LANES
    ).repartition(3)


def scores(found, x):
    pieces = [(r["tree"], r["root"], bytes(r["body"])) for r in found.pieces.collect()]
    return forest.Forest([e.tolist() for e in found.edges], found.base, found.trees, pieces).scores(x)


def plain(x, weight, y, depth, least):
    """A tree by trying every split of every feature: a function of rows."""
    value = np.average(y, weights=weight)
    best, at = 1e-9 * np.var(y) + 1e-12, None
    for f in range(x.shape[1] if depth and len(set(y)) > 1 else 0):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            parts = [(weight[s].sum(), (weight * y)[s].sum()) for s in (left, ~left)]
            gain = sum(s * s / w for w, s in parts) - (weight * y).sum() ** 2 / weight.sum()
            if min(w for w, _ in parts) >= least and gain > best + 1e-9:
                best, at = gain, (f, cut)
    if at is None:
        return lambda row: value
    left = x[:, at[0]] <= at[1]
    low, high = (plain(x[s], weight[s], y[s], depth - 1, least) for s in (left, ~left))
    return lambda row: low(row) if row[at[0]] <= at[1] else high(row)


@pytest.mark.parametrize("local", [1 << 18, 40])
@pytest.mark.parametrize("task", ["binary", "regression"])
def test_trees_are_those_of_a_plain_search(spark, monkeypatch, task, local):
    monkeypatch.setattr(forest, "_LOCAL_ROWS", local)
    chosen = Settings(trees=2, depth=6, features="all", least_rows=3, bins=64)
    data = {0: rows(150, 1, task), 1: rows(180, 2, task)}
    df = lanes(spark, data)
    found = forest.fit(df, chosen, task)
    keys = {(r["lane"], r["key"]): r["h"] for r in df.select("lane", "key", F.xxhash64("key", "label", "features").alias("h")).collect()}
    for lane, (x, y) in data.items():
        trees = []
        for t in range(2):
            weight = forest._weights(np.array([keys[lane, i] for i in range(len(y))], np.int64), t, chosen).astype(float)
            use = weight > 0
            trees.append(plain(x[use], weight[use], y[use], 6, 3))
        want = np.mean([[tree(row) for row in x] for tree in trees], axis=0)
        assert np.allclose(scores(found[lane], x), want)


def test_draws_are_poisson_and_features_a_share():
    weight = forest._weights(np.arange(200_000), 3, Settings())
    assert abs((weight == 0).mean() - math.exp(-1)) < 0.01 and abs(weight.mean() - 1) < 0.01
    assert abs(forest._weights(np.arange(200_000), 3, Settings(row_rate=0.5)).mean() - 0.5) < 0.01
    named = {"sqrt": 4, "log2": 4, "onethird": 4, "all": 12, "auto": 4, "5": 5, "99": 12, "0.5": 6, "1.0": 12}
    assert {k: Settings(features=k).drawn(12, "binary") for k in named} == named
    drawn = forest._drawn([1], 500, forest._Lane(12, 4, 0.0, 0.0))
    assert all(len(set(d)) == 4 for d in drawn.tolist()) and set(drawn.reshape(-1)) == set(range(12))
    for wrong in ({"features": "some"}, {"features": "0"}, {"trees": 0}, {"depth": 31}, {"row_rate": 0}):
        with pytest.raises(TrainingError):
            Settings(**wrong)


def test_odd_tables(spark):
    assert forest.fit(spark.createDataFrame([], LANES), Settings()) == {}
    nan = float("nan")
    # One class, one row, rows that are all the same and share a key, and features that are blank.
    same = spark.createDataFrame([(0, None, 1.0, [2.0, nan])] * 5 + [(1, 1, 0.0, [1.0, 1.0])], LANES)
    found = forest.fit(same, Settings(trees=6, depth=30))
    assert scores(found[0], np.array([[2.0, nan], [9.0, 9.0]])).tolist() == [1.0, 1.0]
    assert scores(found[1], np.array([[0.0, 0.0]])).tolist() == [0.0]
    blank = spark.createDataFrame([(0, i, float(i % 2), [nan if i % 2 else 1.0]) for i in range(60)], LANES)
    assert scores(forest.fit(blank, Settings(trees=9))[0], np.array([[1.0], [nan]])).tolist() == [0.0, 1.0]
    with pytest.raises(TrainingError):
        forest.fit(spark.createDataFrame([(0, 1, None, [1.0])], LANES), Settings())
    with pytest.raises(TrainingError):
        forest.fit(spark.createDataFrame([(0, 1, 2.0, [1.0])], LANES), Settings())


def test_few_jobs_for_all_folds_whatever_the_depth(spark, tmp_path):
    """Spark ML's forest has jobs for every level of every fold."""
    df = spark.range(600).select(
        F.col("id").alias("row_id"), (F.xxhash64("id") % 50).cast("double").alias("x"), (F.xxhash64("id", F.lit(1)) % 7).cast("double").alias("z"),
        (F.xxhash64("id", F.lit(2)) % 2 == 0).cast("int").alias("y"),
    )
    spec = ModelSpec("rf", {"n_estimators": 4})
    spark.sparkContext.setJobGroup("forest", "forest")
    made = []
    whole = forest.fit

    def counted(*given):
        tracker = spark.sparkContext.statusTracker()
        before = len(tracker.getJobIdsForGroup("forest"))
        out = whole(*given)
        made.append(len(tracker.getJobIdsForGroup("forest")) - before)
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(forest, "fit", counted)
        run = training.cross_fit(df, CVConfig(n_splits=3), FeaturesConfig(), [spec], id_col="row_id", target="y")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(made) == 1 and made[0] < 30
    assert run.oof.count() == 600 and all(s is not None for s in run.scores["rf"])
    model = run.fold_models[0]
    assert isinstance(model.stages[-1], fitted.ForestModel)
    model.write().save(str(tmp_path / "m"))
    want = {r["row_id"]: r["probability"] for r in model.transform(df).collect()}
    assert {r["row_id"]: r["probability"] for r in PipelineModel.load(str(tmp_path / "m")).transform(df).collect()} == want
    held = {r["row_id"]: r["oof"] for r in run.oof.filter("fold = 0").collect()}
    assert all(abs(want[i][1] - p) < 1e-12 for i, p in held.items())


def test_scores_are_as_good_as_those_of_spark_ml(spark):
    x, y = rows(1500, 5)
    df = lanes(spark, {0: (x, y)})
    params = {"n_estimators": 20, "max_depth": 8}
    found = forest.fit(df, models.forest_settings("rf", "binary", params))[0]
    new, fresh = rows(1500, 6)
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(new)], "i int, v array<double>").select("i", array_to_vector("v").alias("features"))
    ml = models.make("rf", "binary", params).fit(df.select("label", array_to_vector("features").alias("features")))
    theirs = np.array([r["probability"][1] for r in ml.transform(vectors).orderBy("i").collect()])
    ours = scores(found, new)

    def loss(p):
        return np.mean((p - fresh) ** 2)

    assert loss(ours) < 1.05 * loss(theirs) and np.corrcoef(ours, theirs)[0, 1] > 0.9


def test_many_bins_stay_with_spark_ml():
    assert models.grown_together("rf") and models.grown_together("random_forest", {"max_bins": boosting.MOST_BINS})
    assert not models.grown_together("rf", {"max_bins": 300}) and not models.grown_together("gbc")


@pytest.mark.parametrize("kinds", [3, 10_000])
def test_rows_of_the_same_codes_count_as_one_without_another_tree(kinds):
    """Before, a group sorted every row for each level and feature, however few different ones it had."""
    rng = np.random.default_rng(kinds)
    codes = rng.integers(0, 32, (kinds, 9)).astype(np.uint8)[rng.integers(0, kinds, 4000)]
    weight, y = rng.integers(1, 4, 4000).astype(np.uint8), rng.integers(0, 2, 4000).astype(float)
    merged = forest._merged(codes, weight, y)
    assert len({(c.tobytes(), v) for c, v in zip(codes, y)}) == len(merged[1])
    assert merged[1].sum() == weight.sum()
    lane, settings = forest._Lane(9, 3, 0.0, 1e-9), forest.Settings(trees=2, depth=30)
    one, other = (forest.grown(*rows, lane, 0, [42, 1, 0, 1, 0], settings) for rows in ((codes, weight, y), merged))
    assert one.packed() == other.packed()
