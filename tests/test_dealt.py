"""Tables dealt out evenly, vectors and scores by column functions."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from foldsafe import CVConfig, FeaturesConfig, ModelSpec
from foldsafe.operators import boosting, preprocess, scoring, training
from foldsafe.plans import model_queries
from foldsafe.sources import scratch

ROWS = [
    (i if i % 7 else None, float(i % 5) if i % 3 else None, float("nan") if i % 11 == 0 else i / 7, "abc"[i % 3] if i % 4 else None, int(i * 37 % 10 < 4 + i % 3))
    for i in range(240)
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id int, x double, y double, t string, target int").coalesce(1)


def test_dealt_rows_are_the_same_and_spread(spark, table):
    twice = table.unionByName(table).coalesce(1)
    dealt = scratch.dealt(twice, "test")
    assert dealt.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert dealt.exceptAll(twice).count() == 0 and twice.exceptAll(dealt).count() == 0
    # Rows without an id do not meet in one part.
    blank = dealt.filter("id IS NULL").select(F.spark_partition_id()).distinct().count()
    assert blank > 2


def test_queries_read_even_tables(spark, folder):
    rows = model_queries._plain_passengers(spark, folder)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.fixture(scope="module")
def run(table):
    spec = [ModelSpec("logistic"), ModelSpec("hgb", {"max_iter": 4, "min_samples_leaf": 2}), ModelSpec("gbc", {"n_estimators": 3})]
    rows = table.withColumn("id", F.monotonically_increasing_id())
    return training.cross_fit(rows, CVConfig(n_splits=2), FeaturesConfig(), spec, id_col="id", target="target")


def _odd(table):
    """Rows with blanks and levels that training has not seen."""
    more = table.limit(3).withColumns({"t": F.lit("new"), "x": F.lit(None).cast("double")})
    return table.unionByName(more).withColumn("row", F.monotonically_increasing_id()).drop("target").localCheckpoint()


def test_direct_vectors_equal_assembled_ones(run, table):
    rows = _odd(table)
    for fold_models in run.models.values():
        stages = fold_models[0].stages[:-1]
        ready, vector = preprocess.direct(stages, rows)
        one = {r["row"]: r["v"] for r in ready.select("row", vector.alias("v")).collect()}
        two = {r["row"]: r["v"] for r in PipelineModel(stages).transform(rows).select("row", vector_to_array("features").alias("v")).collect()}
        assert one.keys() == two.keys()
        assert all(np.array_equal(one[k], two[k], equal_nan=True) for k in one)


def test_average_equals_models_one_by_one(run, table):
    rows = _odd(table)
    for fold_models in run.models.values():
        averaged = scoring.fold_average(fold_models, rows)
        assert "UDF(idx__" not in averaged._jdf.queryExecution().toString()
        found = {r["row"]: r["p"] for r in averaged.collect()}
        alone = [{r["row"]: r["p"] for r in m.transform(rows).select("row", vector_to_array("probability")[1].alias("p")).collect()} for m in fold_models]
        assert all(abs(found[k] - (alone[0][k] + alone[1][k]) / 2) < 1e-15 for k in found) and len(found) == 243


def test_direct_keeps_to_narrow_vectors(run, table, monkeypatch):
    monkeypatch.setattr(preprocess, "_MOST_SLOTS", 1)
    assert preprocess.direct(run.fold_models[0].stages[:-1], table) is None
    assert scoring.fold_average(run.fold_models, _odd(table)).filter("p between 0 and 1").count() == 243


def test_flat_trees_equal_walked_ones(monkeypatch):
    random = np.random.default_rng(0)
    x = random.integers(0, 6, (500, 3)).astype(float)
    x[random.random(x.shape) < 0.2] = np.nan
    # A tree whose right half ends early, and a lone leaf.
    trees = [[[0, 1, -1, -1, 2], [2.0, 3.0, 0.0, 0.0, 1.0], [1, 0, 0, 0, 1], [0.0, 0.0, 0.5, 0.25, 0.0]], [[-1], [0.0], [0], [0.125]]]
    trees[0] = [part + [fill] * 6 for part, fill in zip(trees[0], (-1, 0.0, 0, 0.75))]
    state = {"base": 0.5, "trees": trees}
    flat = boosting.margins(state, x)
    monkeypatch.setattr(boosting, "_FLAT_LEVELS", -1)
    assert np.array_equal(flat, boosting.margins(state, x)) and len(np.unique(flat)) > 2
