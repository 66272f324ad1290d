"""Every query with check SQL gives the same rows on both engines; the others give rows."""

import pytest
from oracle import compare, connect

import __spark_entry__ as contract
from foldsafe.plans import REGISTRY


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql is not None])
def test_same_rows(spark, folder, duck, name):
    assert compare(spark, duck, name, folder) is None


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql is None])
def test_gives_rows(spark, folder, name):
    assert REGISTRY[name].build(spark, folder).count() > 0


def test_contract_names():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(contract.queries()) >= set(REGISTRY)
