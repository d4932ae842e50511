"""Deep pages by selection against offsets over the sorted rows."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orderlens.plans import selection
from orderlens.plans.paging import newest_first, offset_page
from orderlens.plans.selection import deep_page, key_at


def rows(n, seed=1):
    rnd = random.Random(seed)
    days = [datetime(2001, 7, 1) + timedelta(microseconds=rnd.randrange(10 ** 12)) for _ in range(n // 3)] + [datetime(1, 1, 1), datetime(9999, 12, 31)]
    return [(i * 3 - 50, rnd.choice([None, *days, days[0], days[0]])) for i in range(n)]


@pytest.mark.parametrize("bins", [2, 7, 4096])
def test_pages_equal_offsets(spark, monkeypatch, bins):
    monkeypatch.setattr(selection, "BINS", bins)
    df = spark.createDataFrame(rows(120), "id long, at timestamp_ntz").repartition(3)
    for page, size in ((1, 10), (4, 10), (13, 9), (12, 10), (120, 1), (121, 1), (50, 20)):
        got = deep_page(df, "at", "id", page, size).collect()
        assert got == offset_page(df, newest_first("at", "id"), page, size).collect()


def test_every_offset_of_dates_with_many_ties(spark):
    data = [(i, None if i % 5 == 0 else date(2001, 1, 1) + timedelta(days=i % 3)) for i in range(40)]
    df = spark.createDataFrame(data, "id int, at date")
    sorted_rows = df.orderBy(*newest_first("at", "id")).collect()
    for offset in (0, 7, 8, 9, 20, 39):
        key = key_at(df, "at", "id", offset)
        assert (key.date, key.id) == (sorted_rows[offset]["at"], sorted_rows[offset]["id"])
    assert key_at(df, "at", "id", 40) is None and key_at(df.limit(0), "at", "id", 0) is None


def test_a_page_keeps_no_more_than_its_own_rows(spark, tmp_path):
    spark.createDataFrame(rows(200), "id long, at timestamp_ntz").write.parquet(str(tmp_path / "t"))
    page = deep_page(spark.read.parquet(str(tmp_path / "t")), "at", "id", 16, 10)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=10," in plan and "offset" not in plan.lower() and "PushedFilters: [Or(" not in plan
    assert "LessThanOrEqual(at" in plan and page.count() == 10


def test_lists_switch_to_selection_at_deep_offsets(spark, monkeypatch):
    from conftest import SF_SMALL
    from orderlens.operators import customers, orders
    from orderlens.sources.fixtures import shop_tables

    t = shop_tables(spark, SF_SMALL)
    plain = orders.list_orders(t, page=30).collect(), customers.list_customers(t, page=4).collect()
    monkeypatch.setattr(orders, "DEEP", 1)
    monkeypatch.setattr(customers, "DEEP", 1)
    assert (orders.list_orders(t, page=30).collect(), customers.list_customers(t, page=4).collect()) == plain
    assert len(plain[0]) == 20 and orders.list_orders(t.with_tables(orders=t.orders.where(F.lit(False))), page=3).count() == 0
