"""Every query against its SQL in DuckDB, to the last bit, on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import TINY

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect
from flowbalance.plans.catalogue import CATALOGUE
from flowbalance.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def duck():
    con = connect(TINY)
    yield con
    con.close()


@pytest.mark.parametrize("name", list(CATALOGUE))
def test_query_equals_its_sql(spark, duck, name):
    assert compare(spark, duck, name, TINY) == ""


def test_every_query_has_sql():
    assert CATALOGUE.keys() == ORACLES.keys()
    assert CATALOGUE.keys() <= queries().keys() and oracle_sql().keys() <= queries().keys()


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["site", "kind", "volume", "fat", "snf", "water", "n_open"]
    assert df.count() == 20
