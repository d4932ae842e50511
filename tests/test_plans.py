"""Plan checks: pushed filters, top-k paging, no cartesian products and no
Python evaluation in any registered query."""

import pytest

import __spark_entry__ as entry
from conftest import AS_OF, SF_SMALL
from orderlens.operators import customers, orders, stats
from orderlens.sources.fixtures import shop_tables
from orderlens.sources.tables import read_parquet_tables, write_tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("shop"))
    write_tables(shop_tables(spark, SF_SMALL), root)
    return read_parquet_tables(spark, root)


def test_period_filter_pushed_and_partitions_pruned(stored):
    p = plan(stats.totals(stored, "month", AS_OF))
    assert "PushedFilters: [IsNotNull(order_date), GreaterThanOrEqual(order_date" in p
    assert "PartitionFilters: [isnotnull(order_month" in p


def test_column_pruning_on_scan(stored):
    p = plan(stats.status_distribution(stored, "all", AS_OF))
    assert "ReadSchema: struct<status:string,order_date:timestamp_ntz>" in p


def test_flat_dossier_reads_only_what_it_returns(stored):
    from orderlens.operators import dossiers

    p = plan(dossiers.order_dossier_flat(stored))
    assert "payment_status" in p and "full_name" in p
    for unread in ("razorpay_signature", "transaction_id", "is_active", "created_at"):
        assert unread not in p


def test_order_page_is_top_k_then_key_filtered(stored):
    from orderlens.plans.paging import offset_page
    page = offset_page(orders.filtered_orders(stored).select(*orders.LIST_COLUMNS), orders.newest(), 3, 20)
    assert "TakeOrderedAndProject(limit=60, offset=40" in plan(page)
    p = plan(orders.list_orders(stored, page=3))
    # the checkpointed page's keys filter the item scan; no second top-k, no
    # global sort of the page, no shuffle of the item table by order
    assert "In(order_id" in p
    assert "TakeOrderedAndProject" not in p and "rangepartitioning" not in p


def test_recent_orders_use_partial_window_group_limit(stored):
    p = plan(customers.recent_orders(stored))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_no_cartesian_and_no_python_in_registered_queries(spark):
    qs = entry.queries()
    skip = {"live_timeline", "status_updates_stream_log"}
    for name, fn in qs.items():
        if name in skip:
            continue
        p = plan(fn(spark, SF_SMALL))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_bucketed_tables_join_on_order_id_without_shuffle(spark):
    from orderlens.sources.tables import read_catalog_tables, write_bucketed_tables

    src = shop_tables(spark, SF_SMALL)
    write_bucketed_tables(src, "shop_bucketed", 4, mode="overwrite")
    t = read_catalog_tables(spark, "shop_bucketed")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        top = stats.top_items(t, "all", AS_OF)
        p = plan(top)
        assert "SortMergeJoin" in p and "Exchange hashpartitioning(order_id" not in p
        from orderlens.operators import orders as ops
        assert "Exchange hashpartitioning(order_id" not in plan(ops.item_counts(t))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = stats.top_items(src, "all", AS_OF).collect()
    assert top.collect() == want


def test_page_keys_and_period_range_reach_the_item_scan(stored):
    p = plan(orders.list_orders(stored, page=2))
    assert "PushedFilters: [In(order_id" in p or "PushedFilters: [IsNotNull(order_id), In(order_id" in p
    p = plan(stats.top_items(stored, "month", AS_OF))
    assert "GreaterThanOrEqual(order_id," in p and "LessThanOrEqual(order_id," in p


def test_user_bucketed_orders_prune_buckets_and_skip_shuffles(spark):
    from orderlens.sources.tables import read_catalog_tables, write_bucketed_tables

    src = shop_tables(spark, SF_SMALL)
    write_bucketed_tables(src, "shop_by_user", 8, mode="overwrite")
    t = read_catalog_tables(spark, "shop_by_user")
    assert t.orders_by_user is not None
    page = customers.list_customers(t, page=1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(customers.list_customers(t, page=1))
        assert "SelectedBucketsCount" in p and "out of 8" in p
        assert "Exchange hashpartitioning(user_id" not in plan(customers.customer_stats(t))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert page.collect() == customers.list_customers(src, page=1).collect()
