"""Every registered query against its SQL, and the driver contract."""

import pytest

import __spark_entry__ as entry
from checks.oracles import Q
from checks.queries import REGISTRY
from checks.compare import connect, differences
from tests.conftest import rows

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_agrees_with_sql(spark, con, name):
    assert differences(entry.queries()[name](spark, SMALL), con, entry.oracle_sql()[name]) == []


def test_every_query_has_sql():
    assert set(REGISTRY) == set(Q)
    assert set(REGISTRY) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert {"month_start", "total_sales", "quarterly_sales", "yearly_sales"} <= set(df.columns)
    assert len(rows(df)) > 0
