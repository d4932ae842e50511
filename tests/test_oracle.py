"""Every registered query against its DuckDB oracle (sf0.001), and the entry."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from oracle_util import compare, duck
from orderlens.queries import ORACLE, QUERIES

QS = QUERIES
ORC = ORACLE


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["item_name", "item_type", "total_quantity", "total_revenue"]


def test_every_query_has_an_oracle_unless_listed():
    assert set(QS) == set(ORC)


@pytest.mark.parametrize("name", sorted(ORC))
def test_query_matches_oracle(spark, con, name):
    res = compare(QS[name](spark, SF_SMALL), con, ORC[name])
    assert res["ok"], res


@pytest.mark.parametrize("name", ["top_items_all", "orders_page", "customer_metrics", "status_updates_log"])
def test_query_matches_oracle_when_derived_in_query(spark, con, name):
    """The same queries with the shop tables derived inside the query plan
    (no materialized copy)."""
    spark.conf.set("orderlens.fixtures.materialize", "false")
    try:
        res = compare(QS[name](spark, SF_SMALL), con, ORC[name])
    finally:
        spark.conf.unset("orderlens.fixtures.materialize")
    assert res["ok"], res
