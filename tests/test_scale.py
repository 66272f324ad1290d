"""Steps that grow with the input: quantiles of all holdouts from shared counts, trees and bins by whole rows of codes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldsafe.operators import boosting, loo, quantiles


@pytest.mark.parametrize("settle", [2, 50_000])
def test_quantiles_of_unions_from_shared_counts(spark, monkeypatch, settle):
    monkeypatch.setattr(quantiles, "SETTLE_ROWS", settle)
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(size=300), [0.0, -0.0, 5e-324, -1e300, 1e300], np.repeat(2.5, 95)))
    part = rng.integers(-1, 3, len(x))
    rows = [(int(p), float(v)) for p, v in zip(part, x)] + [(0, None), (1, float("nan")), (None, 7.0)]
    df = spark.createDataFrame(rows, "part int, x double").repartition(3)
    unions = {0: [-1, 1, 2], 1: [0], 2: [], 3: [9]}
    found = quantiles.by_group(df, F.col("part"), {"x": F.col("x")}, unions, [0.01, 0.5, 0.99])
    for union, parts in unions.items():
        own = x[np.isin(part, parts)]
        if len(own):
            np.testing.assert_allclose(found[union, "x"], np.quantile(own, [0.01, 0.5, 0.99]), rtol=1e-12)
        else:
            assert found[union, "x"] is None


def test_limits_and_medians_of_large_columns_read_the_table_a_few_times(spark, monkeypatch):
    """Before, every holdout, column and end was narrowed in on by itself."""
    passes = []
    plain = quantiles._digit_counts
    monkeypatch.setattr(quantiles, "_digit_counts", lambda *a: passes.append(1) or plain(*a))
    df = spark.range(3000).select(
        "id", (F.col("id") % 5).cast("int").alias("fold"), F.sqrt("id").alias("a"), (F.col("id") % 85).alias("b")
    )
    limits = loo.clip_limits(df, ["a", "b"], 5, small_rows=100).collect()
    assert len(limits) == 10 and len(passes) <= 5
    a, fold = np.sqrt(np.arange(3000)), np.arange(3000) % 5
    for r in limits:
        values = a if r["column"] == "a" else np.arange(3000) % 85
        want = np.quantile(values[fold != r["holdout"]], [0.01, 0.99])
        np.testing.assert_allclose([r["low"], r["high"]], want, rtol=1e-12)
    passes.clear()
    medians = loo.medians(df, ["a", "b"], 5, "stratified", small_rows=100).collect()
    assert len(medians) == 10 and len(passes) <= 5


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_trees_by_whole_rows_of_codes_reach_the_same_nodes(monkeypatch, depth):
    rng = np.random.default_rng(depth)
    codes = rng.integers(0, 256, (4, 500)).astype(np.uint8)
    tree = boosting.Tree.empty(depth)
    inner = 2**depth - 1
    tree.feature[:inner] = rng.integers(0, 4, inner)
    tree.feature[2:inner:3] = -1
    tree.code[:inner] = rng.integers(0, 255, inner)
    tree.missing_left[:inner] = rng.integers(0, 2, inner) > 0
    assert hasattr(tree, "_flat")
    flat = [tree.leaves(codes, level) for level in range(depth + 1)]
    monkeypatch.setattr(boosting, "_FLAT_LEVELS", -1)
    for level, nodes in enumerate(flat):
        np.testing.assert_array_equal(nodes, tree.leaves(codes, level))


@pytest.mark.parametrize("nodes", [1, 8, 2048])
def test_features_counted_together_give_each_its_own_histogram(nodes):
    rng = np.random.default_rng(nodes)
    layout = boosting._Layout([np.arange(n, dtype=float) for n in (2, 254, 3, 1, 6, 40)])
    bundles, sizes = layout.bundles(nodes), layout.sizes.tolist()
    assert sorted(f for b in bundles for f in b) == list(range(6))
    assert nodes > 8 or len(bundles) < 6
    node = rng.integers(0, nodes + 1, 400)
    codes = np.stack([rng.integers(0, s, 400) for s in sizes])
    totals = []
    for bundle in bundles:
        cell = node.copy()
        for f in bundle:
            cell = cell * sizes[f] + codes[f]
        total = np.bincount(cell, minlength=(nodes + 1) * int(np.prod([sizes[f] for f in bundle])))
        totals.append(np.stack([total, 2.0 * total, 3.0 * total]))
    found = layout.histogram(totals, nodes)
    for f, (first, size) in enumerate(zip(layout.first.tolist(), sizes)):
        used = node < nodes
        want = np.bincount(node[used] * size + codes[f][used], minlength=nodes * size).reshape(nodes, size)
        np.testing.assert_array_equal(found[:, :, first: first + size], np.stack([want, 2 * want, 3 * want]))


def test_bins_of_thinned_values_hold_even_shares(spark, monkeypatch):
    monkeypatch.setattr(boosting, "_SORTED_ROWS", 4000)
    monkeypatch.setattr(boosting, "_SUMMARY", 1000)
    rows = spark.range(0, 20_000, 1, 3).select(
        F.lit(0).alias("lane"), F.array((F.col("id") * 7919 % 20_000).cast("double"), (F.col("id") % 3).cast("double")).alias("features")
    )
    wide, narrow = boosting.bin_edges(rows, 21)[0]
    assert wide[0] == 0 and wide[-1] == 19_999 and len(wide) == 21
    np.testing.assert_allclose(wide[1:-1], np.arange(1, 20) * 1000, atol=40)
    assert narrow.tolist() == [0.0, 1.0, 2.0]
