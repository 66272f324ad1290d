"""Boosted trees, shared linear fits and target encoders against plain versions."""

from functools import reduce

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsafe import CVConfig, FeaturesConfig, ModelSpec, SchemaError, TrainingError
from foldsafe.operators import boosting, fitted, linear, loo, models, partials, preprocess, scoring, target_encoding, training
from foldsafe.operators.boosting import Settings

LANES = "lane int, key long, label double, features array<double>"


def plain_booster(x, y, s, task):
    """Scores of a booster that tries every value of every feature as a split."""
    n, mean = len(y), y.mean()
    margin = np.full(n, (np.log(mean / (1 - mean)) if task == "binary" else mean) if s.from_prior else 0.0)

    def score(g, h, rows):
        below = (rows if s.by_rows else h) + s.penalty
        return g * g / below if below > 0 else 0.0

    def sides(rows, f, cut, side):
        v = x[rows, f]
        left = (v <= cut) | (np.isnan(v) & bool(side))
        return rows[left], rows[~left]

    def gain(rows, a, b):
        if min(len(a), len(b)) < max(1, s.least_rows) or min(h[a].sum(), h[b].sum()) < s.least_weight:
            return -np.inf
        parts = [score(g[r].sum(), h[r].sum(), len(r)) for r in (a, b, rows)]
        return parts[0] + parts[1] - parts[2]

    def candidates(rows):
        for f in range(x.shape[1]):
            v = x[rows, f]
            for cut in np.unique(v[~np.isnan(v)]):
                for side in (True, False) if np.isnan(v).any() else (False,):
                    yield f, cut, side

    for _ in range(s.rounds):
        if task == "binary":
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
        else:
            g, h = margin - y, np.ones(n)
        nodes = [np.arange(n)]
        for _ in range(s.depth):
            if s.symmetric:
                best = (1e-12, None)
                for c in candidates(np.arange(n)):
                    found = [gain(r, *sides(r, *c)) for r in nodes]
                    total = sum(v for v in found if np.isfinite(v))
                    if np.isfinite(found).any() and total > best[0] + 1e-9:
                        best = (total, c)
                nodes = [part for r in nodes for part in sides(r, *best[1])] if best[1] else nodes
                continue
            following = []
            for rows in nodes:
                best = (1e-12, None)
                for c in candidates(rows):
                    found = gain(rows, *sides(rows, *c))
                    if found > best[0] + 1e-9:
                        best = (found, c)
                following += sides(rows, *best[1]) if best[1] else [rows]
            nodes = following
        for rows in nodes:
            if len(rows):
                margin[rows] -= s.rate * g[rows].sum() / (h[rows].sum() + s.penalty)
    return margin


@pytest.fixture(scope="module")
def two_lanes(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(0, 1, (2, 120, 3)), 1)
    x[rng.random(x.shape) < 0.15] = np.nan
    x[:, :, 2] = rng.integers(0, 2, (2, 120))
    y = (np.nan_to_num(x[:, :, 0]) + 0.5 * x[:, :, 2] + rng.normal(0, 1, (2, 120)) > 0).astype(float)
    rows = [(lane, i, float(y[lane, i]), [float(v) for v in x[lane, i]]) for lane in range(2) for i in range(120)]
    return x, y, spark.createDataFrame(rows, LANES).repartition(5).persist()


@pytest.mark.parametrize("task", ["binary", "regression"])
@pytest.mark.parametrize("chosen", [
    Settings(rounds=6, depth=3, rate=0.3, penalty=1.0, least_weight=0.5),
    Settings(rounds=2, depth=2, rate=0.5, by_rows=True),
    Settings(rounds=2, depth=3, rate=0.1, least_rows=20),
])
def test_same_scores_as_a_plain_booster(two_lanes, task, chosen):
    x, y, df = two_lanes
    found = boosting.fit(df, chosen, task)
    for lane in range(2):
        got = boosting.margins(found[lane].state(), x[lane])
        assert np.allclose(got, plain_booster(x[lane], y[lane], chosen, task), atol=1e-10)


def test_symmetric_trees(two_lanes):
    """One split per level. Without blanks, so that there is a single choice of sides."""
    x, y, df = two_lanes
    filled = df.withColumn("features", F.transform("features", lambda v: F.when(F.isnan(v), 0.0).otherwise(v)))
    chosen = Settings(rounds=3, depth=2, rate=0.4, penalty=3.0, symmetric=True, from_prior=False)
    found = boosting.fit(filled, chosen)
    for lane in range(2):
        plain = np.nan_to_num(x[lane])
        assert np.allclose(boosting.margins(found[lane].state(), plain), plain_booster(plain, y[lane], chosen, "binary"))
        for tree in found[lane].trees:
            used = [{(tree.feature[i], tree.code[i]) for i in range(2**d - 1, 2 ** (d + 1) - 1)} for d in range(2)]
            assert all(len(level) == 1 for level in used)


def test_penalty_and_shares_act(two_lanes):
    x, y, df = two_lanes
    one = df.filter("lane = 0")
    leaf = {}
    for penalty in (0.0, 10.0):
        tree = boosting.fit(one, Settings(rounds=1, depth=1, rate=1.0, penalty=penalty))[0].trees[0]
        left = x[0][:, tree.feature[0]]
        edge = boosting.bin_edges(one, 255)[0][tree.feature[0]][tree.code[0]]
        rows = np.where(np.isnan(left), tree.missing_left[0], left <= edge)
        p = y[0].mean()
        leaf[penalty] = -(p - y[0][rows]).sum() / (p * (1 - p) * rows.sum() + penalty)
        assert tree.value[1] == pytest.approx(leaf[penalty])
    assert abs(leaf[10.0]) < abs(leaf[0.0])
    whole = boosting.fit(one, Settings(rounds=3, depth=2))[0]
    part = boosting.fit(one, Settings(rounds=3, depth=2, row_share=0.5, feature_share=0.4))[0]
    again = boosting.fit(one.repartition(2), Settings(rounds=3, depth=2, row_share=0.5, feature_share=0.4))[0]
    assert all(len({int(f) for f in t.feature if f >= 0}) <= 1 for t in part.trees)
    assert not np.allclose(boosting.margins(whole.state(), x[0]), boosting.margins(part.state(), x[0]))
    assert np.allclose(boosting.margins(again.state(), x[0]), boosting.margins(part.state(), x[0]))
    key = np.arange(20_000)
    seen = boosting._sampled(key, 1, Settings(row_share=0.3))
    assert abs(seen.mean() - 0.3) < 0.02 and (seen != boosting._sampled(key, 2, Settings(row_share=0.3))).any()


def test_large_histograms_are_added_up_in_tasks(two_lanes, monkeypatch):
    x, y, df = two_lanes
    chosen = Settings(rounds=2, depth=2, rate=0.3)
    want = boosting.margins(boosting.fit(df, chosen)[1].state(), x[1])
    monkeypatch.setattr(boosting, "_DRIVER_BYTES", 0)
    assert np.allclose(boosting.margins(boosting.fit(df, chosen)[1].state(), x[1]), want)


def test_booster_on_awkward_tables(spark):
    nan = float("nan")
    assert boosting.fit(spark.createDataFrame([], LANES), Settings(rounds=2)) == {}
    blank = spark.createDataFrame([(0, i, float(i % 2), [nan, 1.0]) for i in range(10)], LANES)
    found = boosting.fit(blank, Settings(rounds=2))[0]
    assert np.allclose(boosting.margins(found.state(), np.array([[5.0, 7.0], [nan, nan]])), 0.0)
    one_class = spark.createDataFrame([(0, i, 1.0, [float(i)]) for i in range(10)], LANES)
    assert boosting.margins(boosting.fit(one_class, Settings(rounds=2))[0].state(), np.array([[3.0]]))[0] > 10
    with pytest.raises(TrainingError):
        boosting.fit(spark.createDataFrame([(0, 1, None, [1.0])], LANES), Settings(rounds=1))
    with pytest.raises(TrainingError):
        boosting.fit(spark.createDataFrame([(0, 1, 1.0, [1.0]), (0, 2, 0.0, [1.0, 2.0])], LANES), Settings(rounds=1))
    for wrong in ({"bins": 300}, {"rounds": 0}, {"row_share": 0.0}, {"penalty": -1.0}):
        with pytest.raises(TrainingError):
            Settings(**wrong)
    # Values that are infinite or beyond what training saw go to the outer sides.
    edges = boosting.bin_edges(spark.createDataFrame([(0, i, 0.0, [float("inf") if i == 3 else float(i)]) for i in range(4)], LANES), 255)
    assert edges[0][0].tolist() == [0.0, 1.0, 2.0, float("inf")]


def test_blanks_reach_the_trees(spark):
    """The label is whether a number is blank: only a model that sees blanks can tell."""
    rows = [(i, None if i % 3 == 0 else float(i * 7 % 50), "u" if i % 2 else None, int(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, x double, t string, y int")
    run = training.cross_fit(
        df, CVConfig(scheme="stratified", n_splits=3), FeaturesConfig(),
        [ModelSpec("hgb", {"max_iter": 4, "learning_rate": 0.5}), ModelSpec("gbc", {"n_estimators": 2})], id_col="row_id", target="y",
    )
    assert run.scores["hgb"] == [1.0, 1.0, 1.0] and run.best == "hgb"
    assert run.oof.count() == 600
    whole = training.refit(run, df)
    labels = {r["row_id"]: r["y"] for r in scoring.predict_best(whole, df.drop("y"), "row_id", "y").collect()}
    assert labels == {i: int(i % 3 == 0) for i in range(300)}


def test_names_and_their_settings():
    xgb = models.boosting_settings("xgb", "binary", {"reg_lambda": 2.5, "n_jobs": 4})
    assert (xgb.rounds, xgb.depth, xgb.penalty, xgb.row_share, xgb.feature_share, xgb.least_weight) == (400, 4, 2.5, 0.9, 0.9, 1.0)
    cat = models.boosting_settings("catboost", "binary")
    assert (cat.rounds, cat.penalty, cat.symmetric, cat.from_prior) == (800, 3.0, True, False)
    assert models.boosting_settings("catboost", "regression").from_prior
    assert models.boosting_settings("hgb", "binary").least_rows == 20 and models.boosting_settings("gbc", "binary").by_rows


def test_a_boosted_model_is_saved(spark, tmp_path):
    rows = [(Vectors.dense([float(i), float("nan") if i % 4 else 1.0]), float(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, ["features", "label"])
    model = models.make("xgb", "binary", {"n_estimators": 3}).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    loaded = fitted.BoostedModel.load(str(tmp_path / "m"))
    want = [r["probability"] for r in model.transform(df).collect()]
    assert [r["probability"] for r in loaded.transform(df).collect()] == want
    value = models.make("gbc", "regression", {"n_estimators": 2}).fit(df).transform(df)
    assert "probability" not in value.columns and value.filter("prediction IS NULL").count() == 0


def test_linear_models_of_many_lanes(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(1e4, [1.0, 3.0], (3, 90, 2)) - 1e4 * np.array([[0, 1]])
    y = (x[:, :, 1] + rng.normal(0, 3, (3, 90)) > 0).astype(float)
    rows = [(lane, i, float(y[lane, i]), [float(v) for v in x[lane, i]]) for lane in range(3) for i in range(90)]
    with linear.Lanes(spark.createDataFrame(rows, LANES).repartition(4)) as lanes:
        squares = linear.ridge(lanes, 2.0)
        assert lanes.passes == 2
        logs = linear.logistic(lanes, 0.7)
    for lane in range(3):
        z = x[lane] - x[lane].mean(0)
        want = np.linalg.solve(z.T @ z + 2 * np.eye(2), z.T @ (y[lane] - y[lane].mean()))
        assert np.allclose(squares[lane].coefficients, want, atol=1e-9)
        assert squares[lane].intercept == pytest.approx(y[lane].mean() - x[lane].mean(0) @ want, abs=1e-6)
        w = np.array([logs[lane].intercept, *logs[lane].coefficients])
        design = np.c_[np.ones(90), x[lane]]
        slope = design.T @ (1 / (1 + np.exp(-design @ w)) - y[lane]) + np.array([0, *w[1:]]) / 0.7
        assert np.abs(slope[1:]).max() < 1e-3 and logs[lane].steps < 30


def test_separable_labels_and_a_dependent_column(spark):
    rows = [(0, i, float(i > 4), [float(i), 2.0 * i]) for i in range(10)]
    with linear.Lanes(spark.createDataFrame(rows, LANES)) as lanes:
        model = linear.logistic(lanes, 1.0)[0]
        assert np.isfinite(model.coefficients).all()
        assert np.isfinite(linear.ridge(lanes, 0.0)[0].coefficients).all()


def test_wide_linear_models_take_the_iterative_way(spark, monkeypatch):
    df = spark.range(60).select(F.col("id").alias("row_id"), (F.col("id") * 7 % 11).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    cv, spec = CVConfig(scheme="stratified", n_splits=3), [ModelSpec("logistic", {"tol": 1e-12})]
    def run():
        found = training.cross_fit(df, cv, FeaturesConfig(), spec, id_col="row_id", target="y")
        return {r["row_id"]: r["oof"] for r in found.oof.collect()}
    want = run()
    monkeypatch.setattr(linear, "MOST_FEATURES", 0)
    assert run() == pytest.approx(want, abs=1e-6)


def test_partial_sums_through_a_tree(spark, monkeypatch):
    monkeypatch.setattr(partials, "FAN_IN", 3)
    rows = [(k, p, bytearray(np.array([p, k * 0.1], "<f8").tobytes())) for k in range(2) for p in range(20)]
    df = spark.createDataFrame(rows, "k int, part long, body binary").repartition(4)
    got = {r["k"]: partials.array_of(r["body"]).tolist() for r in partials.summed(df, ["k"], 20).collect()}
    assert got == {0: [190.0, 0.0], 1: [190.0, pytest.approx(2.0)]}
    assert partials.collected(df.drop("k").filter("part < 0"), 20) is None


@pytest.fixture(scope="module")
def encoded_rows(spark):
    rng = np.random.default_rng(6)
    level = np.where(rng.random(400) < 0.4, "hot", [f"l{i}" for i in rng.integers(0, 40, 400)])
    return [
        (i, None if i % 29 == 0 else str(level[i]), None if i % 31 == 0 else float(rng.integers(0, 2)), int(i % 4)) for i in range(400)
    ]


def as_frame(spark, rows):
    return spark.createDataFrame(rows, "row_id long, t string, y double, fold int")


def plain_smoothed(rows, smoothing):
    out = {}
    for i, t, _, fold in rows:
        for h in range(4):
            known = [(r[1], r[2]) for r in rows if r[3] not in (h, fold) and r[2] is not None]
            prior = sum(y for _, y in known) / len(known)
            own = [y for u, y in known if u == t]
            out[i, h] = (sum(own) + smoothing * prior) / (len(own) + smoothing)
    return out


def test_smoothed_target_encoding(spark, encoded_rows):
    got = target_encoding.smoothed(as_frame(spark, encoded_rows), "row_id", ["t"], "y", 4, smoothing=7.0).collect()
    assert {(r["row_id"], r["holdout"]): r["encoded"] for r in got} == pytest.approx(plain_smoothed(encoded_rows, 7.0))


@pytest.mark.parametrize("encoder", [target_encoding.smoothed, target_encoding.ordered])
def test_no_row_sees_its_own_label(spark, encoded_rows, encoder):
    """Changing a row's label changes nothing that a model is given for that row, nor anything under its own holdout."""
    one = encoded_rows[45]
    changed = [(*r[:2], 1 - r[2], r[3]) if r is one else r for r in encoded_rows]
    tables = [
        {(r["row_id"], r["holdout"]): r["encoded"] for r in encoder(as_frame(spark, rows), "row_id", ["t"], "y", 4).collect()}
        for rows in (encoded_rows, changed)
    ]
    assert all(tables[0][one[0], h] == tables[1][one[0], h] for h in range(4))
    assert all(tables[0][k] == pytest.approx(tables[1][k]) for k in tables[0] if k[1] == one[3])
    assert any(tables[0][k] != pytest.approx(tables[1][k]) for k in tables[0])


def test_time_order_of_encoders(spark, encoded_rows):
    rows = as_frame(spark, encoded_rows).withColumn("fold", F.col("fold") - 1)
    for encoder in (target_encoding.smoothed, target_encoding.ordered):
        found = encoder(rows, "row_id", ["t"], "y", 3, scheme="timeseries")
        assert found.filter("fold > holdout").count() == 0 and found.filter("fold = holdout").count() == 300
        assert encoder(rows.limit(0), "row_id", ["t"], "y", 3).count() == 0
    with pytest.raises(SchemaError):
        target_encoding.smoothed(rows, "row_id", [], "y", 3)


@pytest.mark.parametrize("small_rows", [1_000_000, 10])
def test_winsorising(spark, small_rows):
    inf, nan = float("inf"), float("nan")
    special = {3: inf, 4: -inf, 5: nan, 6: None}
    rows = [(i, special.get(i, float(i * i % 97)), None, i % 3 if i % 10 else -1) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, x double, z double, fold int")
    limits = loo.clip_limits(df, ["x", "z"], 3, "kfold", 0.1, 0.9, small_rows)
    want = {}
    for h in range(3):
        used = [r[1] for r in rows if r[3] != h and r[1] is not None and np.isfinite(r[1])]
        want[h] = np.quantile(used, [0.1, 0.9])
    got = {r["holdout"]: (r["low"], r["high"]) for r in limits.filter("column = 'x'").collect()}
    assert all(got[h] == pytest.approx(tuple(want[h])) for h in range(3))
    clipped = {r["row_id"]: r["x"] for r in loo.winsorise(df, ["x", "z"], limits).collect()}
    for i, x, _, fold in rows:
        if x is None or x != x:
            assert clipped[i] is None
        else:
            assert clipped[i] == pytest.approx(x if fold < 0 else float(np.clip(x, *want[fold])))
    with pytest.raises(SchemaError):
        loo.clip_limits(df, ["x"], 3, low=0.9, high=0.1)


def test_lanes_hold_the_training_rows(spark):
    df = spark.range(30).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("x"), (F.col("id") % 3).cast("int").alias("fold"), F.lit(1.0).alias("label"))
    preps = preprocess.learn(df, FeaturesConfig(), 3, "kfold", ["row_id", "label"])
    assert [preprocess.width(p) for p in preps] == [1, 1, 1]
    lanes: DataFrame = training._lanes(df, preps, "kfold", "row_id")
    assert reduce(lambda a, r: a + r["n"], lanes.groupBy("lane").agg(F.count(F.lit(1)).alias("n")).collect(), 0) == 60
