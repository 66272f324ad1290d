"""Tables of blocks: what Spark holds of them at a time has a size in bytes, and blocks lose nothing."""

from __future__ import annotations

import glob

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from foldsafe.operators import boosting, forest, linear
from foldsafe.sources import scratch

LANES = "lane int, key long, label double, features array<double>"


def _most_at_once(df):
    """The largest batch of the table's rows that a task gets."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    return df.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]


def _row_groups(folder):
    for file in glob.glob(f"{folder}/*.parquet"):
        held = pq.ParquetFile(file).metadata
        yield from (held.row_group(i).total_byte_size for i in range(held.num_row_groups))


@pytest.fixture()
def folder(monkeypatch):
    paths = []
    plain = scratch.new_path
    monkeypatch.setattr(scratch, "new_path", lambda *a: paths.append(plain(*a)) or paths[-1])
    return paths


def test_blocks_are_read_in_groups_and_batches_of_bounded_size(spark, folder):
    """Before, both were counted in rows: a part of 200 blocks of 300 KB was one row group and one batch of 60 MB."""
    rows = spark.range(0, 200, 1, 1).select("id", F.randstr(F.lit(300_000), F.lit(1)).cast("binary").alias("body"))
    kept = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    found = scratch.blocks(rows, "test")
    assert found.count() == 200 and found.dtypes == rows.dtypes
    assert _most_at_once(found) < 10 << 20
    assert max(_row_groups(folder[0].removeprefix("file:"))) < 14 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == kept


def test_rows_of_linear_models_take_few_bytes_and_bounded_batches(spark, folder):
    """Before, a row took 8 bytes a feature, and up to 10,000 rows of them were one value."""
    n = 40_000
    rows = spark.range(0, n, 1, 1).select(
        F.lit(0).alias("lane"), F.col("id").alias("key"), (F.col("id") % 2).cast("double").alias("label"),
        F.array(F.rand(1), *[(F.col("id") % (k + 2) == 0).cast("double") for k in range(39)]).alias("features"),
    )
    with linear.Lanes(rows) as lanes:
        total = lanes.sums(lambda lane, x, y: np.concatenate(([len(x)], x.sum(0), [y.sum()])))[0]
        assert lanes._blocks.agg(F.max(F.length("label"))).first()[0] <= 8 * linear._BLOCK_ROWS
        assert lanes._blocks.agg(F.sum(F.length("x"))).first()[0] < 20 * n
    assert total[0] == total[1] == n and total[-1] == n / 2
    np.testing.assert_allclose(total[3:-1], [len(range(0, n, k + 2)) for k in range(39)])


@pytest.mark.parametrize("rows", [1, 7, 8, 9, 600])
def test_coded_columns_are_the_same_bit_for_bit(rows):
    rng = np.random.default_rng(rows)
    columns = [rng.normal(size=rows), np.where(rng.random(rows) < 0.5, -0.0, 0.0), np.full(rows, 5e-324), np.full(rows, np.inf)]
    columns += [rng.integers(0, k, rows) * 0.1 for k in (2, 3, 255, 256, 257, 258)]
    x = np.column_stack(columns)
    found = linear._decoded(pa.py_buffer(linear._encoded(x)), rows)
    assert (found[:, 0] == 1).all()
    assert np.ascontiguousarray(found[:, 1:]).tobytes() == np.ascontiguousarray(x).tobytes()


@pytest.mark.parametrize("kind", ["boosting", "forest"])
def test_codes_of_trees_lie_in_bounded_row_groups(spark, folder, monkeypatch, kind):
    """Before, a file of any size was one row group, which a task reads whole."""
    monkeypatch.setattr(scratch, "_GROUP_BYTES", 1 << 18)
    rows = spark.range(0, 60_000, 1, 1).select(
        F.lit(0).alias("lane"), F.col("id").alias("key"), (F.col("id") % 2).cast("double").alias("label"),
        F.array(F.rand(1), F.rand(2), F.rand(3)).alias("features"),
    )
    if kind == "boosting":
        monkeypatch.setattr(boosting, "_BLOCK_ROWS", 1 << 10)
        boosting.fit(rows, boosting.Settings(rounds=1, depth=1))
    else:
        monkeypatch.setattr(boosting, "_BLOCK_ROWS", 1 << 10)
        forest.fit(rows, forest.Settings(trees=1, depth=2))
    state = next(p for p in folder if f"{kind}-state" in p).removeprefix("file:")
    sizes = list(_row_groups(state))
    assert max(sizes) < 1 << 19 < sum(sizes)


def test_values_of_several_lanes_are_held_together_up_to_a_bound(monkeypatch):
    """Before, every lane of a part had the whole number of rows to itself."""
    monkeypatch.setattr(boosting, "_SORTED_ROWS", 1000)
    read = []

    def batches():
        for i in range(40):
            read.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i % 4] * 100, pa.int32()), pa.array([[float(i * 100 + j)] for j in range(100)])], names=["lane", "features"]
            )

    found = [(len(read), batch.column(0)[0].as_py(), np.frombuffer(batch.column(2)[0].as_py(), "<f8")) for batch in boosting._summaries(batches())]
    assert found[0][0] == 10
    for lane in range(4):
        values = np.sort(np.concatenate([v for _, of, v in found if of == lane]))
        np.testing.assert_array_equal(values, [i * 100 + j for i in range(lane, 40, 4) for j in range(100)])
