"""Period figures from the hourly roll-up against the direct ones."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from conftest import AS_OF, make_tables, order
from orderlens.functions.period import PERIODS, period_bounds
from orderlens.operators import stats
from orderlens.operators.updates import apply_status_updates
from orderlens.sources import rollup


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def tables(spark):
    hours = [AS_OF - timedelta(minutes=37 * i) for i in range(150)]
    rows = [order(i, when=h, total=None if i % 7 == 0 else i, status=[None, "pending", "shipped"][i % 3]) for i, h in enumerate(hours)]
    rows += [order(900, when=None), order(901, when=datetime(1, 1, 1)), order(902, when=AS_OF), order(903, when=AS_OF + timedelta(seconds=1)),
             order(904, when=datetime(2001, 6, 30, 23, 59, 59, 999999)), order(905, when=datetime(2001, 7, 1))]
    ups = [(i, [3, 3, 900, 77, 12345, 902][i % 6], ["delivered", "pending", None][i % 3], 1, None, datetime(2001, 7, 1) + timedelta(hours=i))
           for i in range(12)]
    return make_tables(spark, orders=rows, updates=ups)


@pytest.mark.parametrize("as_of", [AS_OF, datetime(2001, 7, 31, 12, 34, 56, 789), datetime(2001, 7, 31)])
def test_figures_equal_the_direct_ones_before_and_after_updates(spark, tmp_path, as_of):
    t = tables(spark)
    store = rollup.rollup_store(spark, str(tmp_path / "r"), fanout=2)
    rollup.add_orders(store, 0, t.orders)
    for now in (0, 1):
        for period in PERIODS if as_of == AS_OF else ("today", "week", "month"):
            same(rollup.totals(store, t.orders, period, as_of), stats.totals(t, period, as_of))
            same(rollup.status_distribution(store, t.orders, period, as_of), stats.status_distribution(t, period, as_of))
            same(rollup.timeline(store, t.orders, period, as_of), stats.timeline(t, period, as_of))
        if now == 0:
            result = apply_status_updates(t.orders, t.status_updates)
            rollup.change_statuses(store, 1, t.orders, result.changes)
            rollup.change_statuses(store, 1, t.orders, result.changes)  # a replay
            t = t.with_tables(orders=result.snapshot)


@pytest.mark.parametrize("period", PERIODS)
@pytest.mark.parametrize("as_of", [AS_OF, datetime(2001, 7, 31, 12, 34, 56, 789), datetime(2001, 3, 1), datetime(2001, 3, 1, 0, 0, 0, 1)])
def test_whole_hours_and_edges_make_up_the_period(period, as_of):
    start, end = period_bounds(period, as_of)
    first, last, edges = rollup.cut_hours(start, end)
    pieces = [(first, last - rollup.MICROSECOND)] if first < last else []
    pieces = sorted(pieces + edges)
    assert pieces[0][0] == start and pieces[-1][1] == end
    assert all(a[1] + rollup.MICROSECOND == b[0] for a, b in zip(pieces, pieces[1:]))
    assert len(edges) <= 2 and all(hi - lo < timedelta(hours=1) for lo, hi in edges)


def test_only_the_cut_hours_are_read_from_the_orders(spark, tmp_path):
    t = tables(spark)
    t.orders.repartitionByRange(4, "order_date").write.parquet(str(tmp_path / "orders"))
    orders = spark.read.parquet(str(tmp_path / "orders"))
    _, _, edges = rollup.cut_hours(*period_bounds("week", datetime(2001, 7, 31, 12, 30)))
    plan = rollup.edge_orders(orders, edges)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("GreaterThanOrEqual(order_date") == 2  # a pushed range for each cut hour
    assert rollup.edge_orders(orders, edges).count() <= 4


def test_a_store_without_batches_gives_zeros(spark, tmp_path):
    t = make_tables(spark)
    store = rollup.rollup_store(spark, str(tmp_path / "r"))
    same(rollup.totals(store, t.orders, "all", AS_OF), stats.totals(t, "all", AS_OF))
    assert rollup.timeline(store, t.orders, "all", AS_OF).count() == 0


def test_orders_after_the_updates_are_a_view_of_the_stored_ones(spark):
    from conftest import SF_SMALL
    from orderlens.queries import _rollup
    from orderlens.sources.fixtures import shop_tables

    t = shop_tables(spark, SF_SMALL)
    now = _rollup(t)["changed"][1]
    assert set(t.orders.inputFiles()) <= set(now.inputFiles())  # no copy of all orders is written
    assert now.count() == t.orders.count()
