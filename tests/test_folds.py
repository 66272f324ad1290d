"""Fold guarantees, checked against brute force on small tables."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldsafe import CVConfig, SchemaError
from foldsafe.operators import ranks, splits


@pytest.fixture(scope="module")
def rows(spark):
    """1003 rows; one instant and one group hold a third of them each."""
    hot = F.col("id") % 3 == 0
    return spark.range(1003).select(
        F.col("id").alias("row_id"),
        (F.col("id") % 10 < 3).cast("int").alias("target"),
        F.when(hot, F.lit(500)).otherwise(F.col("id") * 7 % 1000).alias("moment"),
        F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 41).cast("string"))).alias("g"),
    ).persist()


def _md5(row_id, seed=42):
    return hashlib.md5(f"{row_id}|{seed}".encode()).hexdigest()


def _folds(df):
    return {r["row_id"]: r["fold"] for r in df.select("row_id", "fold").collect()}


@pytest.mark.parametrize("k", [2, 3, 5, 7])
def test_kfold_blocks(spark, rows, k):
    got = _folds(splits.kfold(rows, "row_id", k))
    order = sorted(got, key=_md5)
    want = {r: i for i, block in enumerate(np.array_split(order, k)) for r in block}
    assert got == want


def test_kfold_in_id_order(rows):
    got = _folds(splits.kfold(rows, "row_id", 4, shuffle=False))
    assert got == {r: i for i, block in enumerate(np.array_split(range(1003), 4)) for r in block}


def test_more_folds_than_rows(spark):
    tiny = spark.range(3).select(F.col("id").alias("row_id"), F.lit(1).alias("target"))
    got = _folds(splits.kfold(tiny, "row_id", 5))
    assert sorted(got.values()) == [0, 1, 2]
    assert sorted(_folds(splits.stratified(tiny, "row_id", "target", 5)).values()) == [0, 1, 2]


@pytest.mark.parametrize("k", [2, 5])
def test_stratified_balance(rows, k):
    got = splits.stratified(rows, "row_id", "target", k).select("fold", "target").collect()
    sizes = Counter(r["fold"] for r in got)
    assert len(got) == 1003 and max(sizes.values()) - min(sizes.values()) <= 1
    for label in (0, 1):
        share = Counter(r["fold"] for r in got if r["target"] == label)
        assert max(share.values()) - min(share.values()) <= 1


def test_timeseries_with_a_hot_instant(rows):
    k, n = 4, 1003
    got = _folds(splits.timeseries(rows, "row_id", "moment", k))
    keys = {r["row_id"]: (r["moment"], _md5(r["row_id"])) for r in rows.collect()}
    size = n // (k + 1)
    first = n - k * size
    want = {}
    for place, row in enumerate(sorted(keys, key=keys.get)):
        want[row] = -1 if place < first else (place - first) // size
    assert got == want


def test_groups_stay_whole_and_balanced(rows):
    got = splits.group(rows, "g", 3).select("g", "fold").collect()
    assert len(got) == 1003
    folds = defaultdict(set)
    for r in got:
        folds[r["g"]].add(r["fold"])
    assert all(len(f) == 1 for f in folds.values())
    loads = [0, 0, 0]
    sizes = Counter(r["g"] for r in got)
    want = {}
    for name in sorted(sizes, key=lambda g: (-sizes[g], g)):
        want[name] = loads.index(min(loads))
        loads[want[name]] += sizes[name]
    assert {g: f.pop() for g, f in folds.items()} == want


def test_small_groups_fill_up_the_folds(rows):
    got = splits.group(rows, "g", 3, placed=1).select("g", "fold").collect()
    sizes = Counter(r["fold"] for r in got)
    largest_small = max(n for g, n in Counter(r["g"] for r in got).items() if g != "hot")
    assert sum(sizes.values()) == 1003 and len(sizes) == 3
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest_small


def test_rows_without_a_group_are_one_group(spark):
    df = spark.range(60).select(
        F.col("id").alias("row_id"), F.when(F.col("id") > 20, F.col("id") % 5).alias("g")
    )
    got = splits.group(df, "g", 3).collect()
    assert len(got) == 60
    assert len({r["fold"] for r in got if r["g"] is None}) == 1


def test_folds_do_not_depend_on_partitioning(spark, rows):
    want = _folds(splits.stratified(rows, "row_id", "target", 5))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            again = rows.repartition(int(parts), F.rand(3))
            assert _folds(splits.stratified(again, "row_id", "target", 5)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rank_has_no_gaps(rows):
    for order in (None, "moment"):
        got = ranks.global_rank(rows, "row_id", order_col=order).select("rank").collect()
        assert sorted(r["rank"] for r in got) == list(range(1003))


def test_time_order_in_a_zone_with_summer_time(spark):
    """The clock goes back in this zone on that day; a time without zone knows nothing of it."""
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.range(600).select(
            F.col("id").alias("row_id"),
            F.expr("timestamp_ntz'2023-11-05 00:00:00' + make_dt_interval(0, 0, 0, (id * 37 % 300) * 60 + id % 2 * 0.000001)").alias("t"),
        )
        rows = df.collect()
        got = {r["row_id"]: r["rank"] for r in ranks.global_rank(df, "row_id", order_col="t").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    keys = {r["row_id"]: (r["t"], _md5(r["row_id"])) for r in rows}
    assert got == {row: i for i, row in enumerate(sorted(keys, key=keys.get))}


@pytest.mark.parametrize("kind", ["decimal(38,0)", "bigint", "double", "date"])
def test_order_by_other_types(spark, kind):
    big = (F.col("id") * 7919 % 500 + (0 if kind == "date" else 2**60)).cast("bigint")
    value = F.date_add(F.lit("2020-01-01").cast("date"), big.cast("int")) if kind == "date" else big.cast(kind)
    df = spark.range(500).select(F.col("id").alias("row_id"), value.alias("v"))
    keys = {r["row_id"]: (r["v"], _md5(r["row_id"])) for r in df.collect()}
    got = {r["row_id"]: r["rank"] for r in ranks.global_rank(df, "row_id", order_col="v").collect()}
    assert got == {row: i for i, row in enumerate(sorted(keys, key=keys.get))}


def test_text_gives_no_order(spark):
    df = spark.range(3).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("t"))
    with pytest.raises(SchemaError):
        splits.timeseries(df, "row_id", "t", 2)


def test_empty_table(spark):
    empty = spark.range(0).select(F.col("id").alias("row_id"), F.lit(1).alias("target"))
    assert splits.kfold(empty, "row_id", 3).count() == 0
    assert splits.stratified(empty, "row_id", "target", 3).count() == 0


def test_scheme_is_honoured(rows):
    cfg = CVConfig(scheme="group", n_splits=3, group_column="g")
    assert splits.assign(rows, cfg, "row_id").select("g", "fold").distinct().count() == rows.select("g").distinct().count()
    with pytest.raises(SchemaError):
        CVConfig(scheme="other")
    with pytest.raises(SchemaError):
        splits.assign(rows, CVConfig(scheme="stratified"), "row_id", "nowhere")


def test_no_one_task_window_over_rows(rows):
    """Windows without a partition key may only see the cell table, never the rows."""
    plan = splits.kfold(rows, "row_id", 5)._jdf.queryExecution().toString()
    for line in plan.splitlines():
        if "Window" in line and "row_number" in line:
            assert "_sub#" in line.split("windowspecdefinition(")[1].split("ASC")[0]


@pytest.mark.parametrize("broadcast", [True, False])
def test_many_classes_when_the_limit_is_raised(spark, monkeypatch, broadcast):
    """1201 classes, one with a third of the rows and one of nulls: rows dealt in turn in class order."""
    if not broadcast:
        monkeypatch.setattr(ranks, "_FEW_CUTS", 10)
    label = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") < 9, None).otherwise(F.col("id") % 1201)
    many = spark.range(3603).select(F.col("id").alias("row_id"), label.cast("int").alias("target")).persist()
    with pytest.raises(SchemaError):
        splits.assign(many, CVConfig(scheme="stratified"), "row_id", "target")
    cfg = CVConfig(scheme="stratified", n_splits=3, most_classes=2000)
    got = _folds(splits.assign(many, cfg, "row_id", "target"))
    members = defaultdict(list)
    for r in many.collect():
        members[r["target"]].append(r["row_id"])
    want, first = {}, 0
    for key in sorted(members, key=lambda c: -1 if c is None else c):
        shares = Counter((first + i) % 3 for i in range(len(members[key])))
        first += len(members[key])
        dealt = [fold for fold in range(3) for _ in range(shares[fold])]
        want.update(zip(sorted(members[key], key=_md5), dealt))
    assert got == want
    assert cfg.flags()["most_classes"] == 2000 and "most_classes" not in CVConfig().flags()


def test_cells_of_several_classes_do_not_meet_in_one_task(rows):
    """The only window without a partition runs over the classes' totals."""
    plan = ranks.global_rank(rows, "row_id", 42, "target")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # The classes are an order in that one only; the others are cut by them.
    bare = [line for line in windows if "[_class" in line[line.rindex("["):] and " ASC " in line[line.rindex("["):]]
    assert len(windows) > 1 and all(", [_class" in line for line in windows)
    assert len(bare) == 1 and "sum(all" in bare[0]
