"""Profiles of wide tables and of long texts, against plain versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldsafe.operators import moments, profile


def _grid(found, names):
    rows = {(r["column_a"], r["column_b"]): r["corr"] for r in found.collect()}
    assert len(rows) == len(names) ** 2
    return rows


def test_correlations_of_five_hundred_columns(spark):
    made = np.random.default_rng(5)
    base = made.normal(size=(400, 20))
    x = base @ made.normal(size=(20, 500)) + made.normal(size=(400, 500)) + 1e6
    x[made.random(x.shape) < 0.1] = np.nan
    names = [f"c{i}" for i in range(500)]
    df = spark.createDataFrame([(row.tolist(),) for row in x], "x array<double>").repartition(7)
    wide = df.select([F.col("x")[i].alias(c) for i, c in enumerate(names)])
    got = _grid(profile.correlations(wide, names), names)
    expected = pd.DataFrame(x, columns=names).corr().to_numpy()
    found = np.array([[got[a, b] for b in names] for a in names], dtype=float)
    assert np.abs(found - expected).max() < 1e-8


@pytest.mark.parametrize("block,pairs", [(2, 1), (3, 2), (256, 16)])
def test_blocks_of_correlations_agree_with_one_aggregate(spark, block, pairs):
    made = np.random.default_rng(6)
    rows = [tuple(None if made.random() < 0.2 else float(made.integers(-5, 9)) for _ in range(5)) for _ in range(90)]
    names = ["a", "b c", "d", "e", "f"]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names)).repartition(5)
    got = _grid(moments.correlations(df, names, block, pairs), names)
    plain = pd.DataFrame(rows, columns=names, dtype=float).corr()
    for a in names:
        for b in names:
            assert got[a, b] == pytest.approx(plain.loc[a, b], abs=1e-12)


def test_correlations_without_spread_or_rows(spark):
    df = spark.createDataFrame(
        [(1.0, 7.1, None, 1.0), (2.0, 7.1, None, float("inf")), (4.0, 7.1, 3.0, 2.0), (5.0, float("nan"), None, 3.0)],
        "x double, same double, once double, endless double",
    )
    names = df.columns
    got = _grid(moments.correlations(df, names), names)
    assert math.isclose(got["x", "x"], 1.0)
    assert {v for (a, b), v in got.items() if (a, b) != ("x", "x")} == {None}
    assert set(_grid(moments.correlations(df.limit(0), names), names).values()) == {None}
    assert moments.correlations(df, []).count() == 0


def test_top_of_long_texts(spark):
    same = "é" * 70
    rows = [(same + "b", "long"), (same + "b", "long"), (same + "a", "long"), (same + "a", "long"), (same + "0", None)]
    rows += [("z", None), (None, "x" * 64), (None, "x" * 65), (None, "x" * 64), (None, "x" * 65), (None, None)]
    df = spark.createDataFrame(rows, "t string, u string").repartition(4)
    got = {r["column"]: r for r in profile.describe_all(df).collect()}
    assert (got["t"]["top"], got["t"]["freq"], got["t"]["unique"], got["t"]["count"]) == (same + "a", 2, 4, 6)
    assert (got["u"]["top"], got["u"]["freq"], got["u"]["unique"], got["u"]["count"]) == ("long", 4, 3, 8)
    tied = df.filter("t is null")
    assert {r["column"]: r["top"] for r in profile.describe_all(tied).collect()} == {"t": None, "u": "x" * 64}


def test_top_of_many_candidates_is_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(profile, "_FEW_CANDIDATES", 3)
    head = "same beginning " * 10
    df = spark.range(50).select(F.concat(F.lit(head), F.format_string("%03d", 149 - F.col("id"))).alias("t"))
    row = profile.describe_all(df).first()
    assert (row["top"], row["freq"], row["unique"]) == (head + "100", 1, 50)


def test_texts_are_not_shuffled_whole(spark):
    """What a task hands out per value is its hashes and a short beginning, however long the texts."""
    df = spark.range(40).select(F.repeat(F.col("id").cast("string"), 50_000).alias("t"))
    row = profile.describe_all(df).first()
    assert (row["top"][:3], row["freq"], row["unique"]) == ("000", 1, 40)
    head = F.left("t", F.lit(profile._PREFIX))
    assert df.select(F.max(F.length(head))).first()[0] == 64
