"""Stored shop tables: each written when it is first asked for, in partitions that keep their size."""

from __future__ import annotations

import os

from conftest import SF_SMALL
from orderlens.queries import OPERATORS, QUERIES, for_check
from orderlens.sources import fixtures
from orderlens.sources.fixtures import StoredTables, derived_tables


def written(t):
    return sorted(os.listdir(t._root.removeprefix("file:"))) if os.path.isdir(t._root.removeprefix("file:")) else []


def test_only_the_tables_that_are_read_are_written(spark):
    t = StoredTables(spark, derived_tables(spark, SF_SMALL))
    assert written(t) == []
    assert t.users.count() == 150 and written(t) == ["users"]
    few = t.with_tables(users=t.users.limit(3))
    assert few.users.count() == 3 and few.orders.count() == t.orders.count() == 1500
    assert written(t) == ["orders", "users"] and t.users.count() == 150
    assert t.names() == few.names() and t.orders_by_user is None


def test_partitions_grow_with_the_sources(spark, monkeypatch):
    small = StoredTables(spark, derived_tables(spark, SF_SMALL)).orders
    monkeypatch.setattr(fixtures, "PARTITION_BYTES", 1000)
    large = StoredTables(spark, derived_tables(spark, SF_SMALL)).orders
    assert len(small.inputFiles()) <= spark.sparkContext.defaultParallelism < len(large.inputFiles())
    assert sorted(small.collect(), key=lambda r: r.order_id) == sorted(large.collect(), key=lambda r: r.order_id)


def test_a_query_that_reads_each_table_once_writes_none(spark, monkeypatch):
    tables = StoredTables(spark, derived_tables(spark, SF_SMALL))
    monkeypatch.setattr(fixtures, "shop_tables", lambda *_: tables)
    for name in ("order_dossier_flat", "order_dossier_flat_ids_some", "order_dossier_flat_ids_many"):
        got = QUERIES[name](spark, SF_SMALL)
        assert written(tables) == [], name
        want = for_check(OPERATORS[name](derived_tables(spark, SF_SMALL)))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name


def test_unwritten_tables_are_those_given_then_those_stored(spark):
    t = StoredTables(spark, derived_tables(spark, SF_SMALL))
    files = set(t.users.inputFiles())
    few = t.with_tables(payments=t._derived.payments.limit(3)).unwritten()
    assert set(few.users.inputFiles()) == files and few.payments.count() == 3
    assert few.orders.count() == 1500 and few.orders_by_user is None and written(t) == ["users"]
