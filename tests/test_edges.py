"""Hand-written edge rows (FIXTURES.md section 3)."""

from datetime import date, datetime

import pytest

from conftest import AS_OF, D, item, make_tables, order, user
from orderlens.operators import catalogue, charts, customers, dossiers, orders, stats, updates


def test_empty_tables(spark):
    t = make_tables(spark)
    assert tuple(stats.totals(t, "all", AS_OF).first()) == (0, 0.0, 0.0)
    from orderlens.plans.paging import page_count
    assert page_count(orders.count_orders(t)).first()["total_pages"] == 1
    assert stats.best_seller(t, "all", AS_OF).first()["best_seller"] == "N/A"
    assert stats.dashboard_kpis(t, AS_OF).count() == 1


def test_nulls_in_totals_status_and_lists(spark):
    t = make_tables(spark, orders=[
        order(1, total=None), order(2, when=None), order(3, status=None), order(4, total=30)],
        users=[user(1)])
    tot = stats.totals(t, "all", AS_OF).first()
    # order 2 has no date: outside every period; order 1 has no total: skipped by SUM/AVG
    assert tot["total_orders"] == 3 and tot["total_revenue"] == 40.0 and tot["avg_order_value"] == 20.0
    dist = {r["status"]: r["count"] for r in stats.status_distribution(t, "all", AS_OF).collect()}
    assert dist == {"pending": 2, None: 1}
    page = orders.list_orders(t).collect()
    assert page[0]["order_id"] == 2  # NULL date first, as Postgres DESC
    labels = [r["label"] for r in charts.chart_status(stats.status_distribution(t, "all", AS_OF)).collect()]
    assert labels == ["Unknown", "Pending"]


def test_order_without_items_and_without_user(spark):
    t = make_tables(spark, orders=[order(1, user_id=None), order(2, user_id=0), order(3, user_id=7)],
                    items=[item(10, 3), item(11, 3)], users=[user(0), user(7)])
    counts = {r["order_id"]: r["item_count"] for r in orders.item_counts(t).collect()}
    assert counts == {1: 0, 2: 0, 3: 2}
    heads = {r["order_id"]: r["customer"] for r in dossiers.order_headers(t).collect()}
    assert heads[1] is None and heads[2] is None and heads[3]["user"]["id"] == 7


def test_item_type_names(spark):
    svc = [(5, "Haircut", "d", "c", D(1), D(0), "active")]
    t = make_tables(spark, orders=[order(1)], users=[user(1)], services=svc,
                    items=[item(1, 1, "service", 5), item(2, 1, "service", 6), item(3, 1, "combo", 5)])
    names = {r["order_item_id"]: r["full_name"] for r in dossiers.named_items(t).collect()}
    assert names == {1: "Haircut", 2: None, 3: "Unknown Item"}


def test_two_payments_and_two_default_addresses(spark):
    t = make_tables(spark, orders=[order(1)], users=[user(1)],
                    payments=[(9, 1, D(5), "failed", "t9", None), (4, 1, D(5), "completed", "t4", None)],
                    addresses=[(21, 1, True, "A", "S"), (20, 1, True, "B", "S"), (19, 1, False, "C", "S")])
    pays = dossiers.first_payments(t).collect()
    assert len(pays) == 1 and pays[0]["payment"]["payment_id"] == 4
    addr = dossiers.default_addresses(t).collect()
    assert len(addr) == 1 and addr[0]["address"]["id"] == 20
    ranks = [r["id"] for r in customers.addresses_ranked(t).orderBy("default_rank", "id").collect()]
    assert ranks == [20, 21, 19]


def test_period_ends_inclusive(spark):
    start, end = datetime(2001, 7, 24, 12), AS_OF
    us = datetime.resolution
    t = make_tables(spark, users=[user(1)], orders=[
        order(1, when=start), order(2, when=end), order(3, when=start - us), order(4, when=end + us)])
    ids = {r["order_id"] for r in stats.in_period(t.orders, "week", AS_OF).collect()}
    assert ids == {1, 2}


@pytest.mark.parametrize("term,expected", [
    ("50%", {1, 2}), ("a_b", {3, 4, 5}), ("a\\b", {5}), ("ALICE", {6}),
])
def test_search_terms(spark, term, expected):
    names = {1: "x50y", 2: "50%", 3: "a_b", 4: "axb", 5: "a\\b", 6: "alice"}
    t = make_tables(spark, users=[user(1)], orders=[order(i, name=n, phone="-", email="-") for i, n in names.items()])
    got = {r["order_id"] for r in orders.filtered_orders(t, search=term).collect()}
    # order ids also match as text: "1".."6" contain no search term here
    assert got == expected


def test_ties_broken_by_id_and_name(spark):
    when = datetime(2001, 7, 31, 9)
    t = make_tables(spark, users=[user(1)], orders=[order(i, when=when) for i in (3, 1, 4, 2)],
                    items=[item(1, 1, name="B", qty=2), item(2, 2, name="A", qty=2), item(3, 3, name="C", qty=1)])
    assert [r["order_id"] for r in orders.list_orders(t).collect()] == [4, 3, 2, 1]
    assert [r["item_name"] for r in stats.top_items(t, "all", AS_OF).collect()] == ["A", "B", "C"]


def test_quantity_zero_average_price(spark):
    t = make_tables(spark, users=[user(1)], orders=[order(1)], items=[item(1, 1, qty=0, total=5)])
    row = stats.with_avg_price(stats.top_items(t, "all", AS_OF)).first()
    assert row["avg_price"] == 0.0 and row["avg_price_formatted"] == "₹0.00"


def test_same_status_update_and_unknown_order(spark):
    ts = datetime(2001, 7, 31, 10)
    t = make_tables(spark, users=[user(1)], orders=[order(1, status="pending")], updates=[
        (1, 1, "pending", 9, "note", ts), (2, 99, "shipped", 9, None, ts),
        (3, 1, "shipped", 9, None, datetime(2001, 7, 31, 11))])
    res = updates.apply_status_updates(t.orders, t.status_updates)
    logs = sorted((r["log_id"], r["old_status"], r["new_status"], r["details"]) for r in res.logs.collect())
    assert logs == [(1, "pending", "pending", "note"), (3, "pending", "shipped", None)]
    assert [(r["update_id"], r["reason"]) for r in res.rejects.collect()] == [(2, "Order not found")]
    assert res.snapshot.first()["status"] == "shipped"


def test_page_below_one_is_an_error(spark):
    t = make_tables(spark)
    with pytest.raises(ValueError):
        orders.list_orders(t, page=0)
    with pytest.raises(ValueError):
        customers.list_customers(t, page=-1)


def test_customers_without_orders_get_zeros(spark):
    t = make_tables(spark, users=[user(1, created=date(2001, 7, 30)), user(2)], orders=[order(1, user_id=1, total=7)])
    rows = {r["id"]: (r["total_orders"], r["total_spent"], r["last_order_date"])
            for r in customers.customer_metrics(t).collect()}
    assert rows[2] == (0, 0.0, None) and rows[1][0] == 1
    page = customers.list_customers(t).collect()
    assert [r["id"] for r in page] == [2, 1]
    stats_ = {r["user_id"]: r["avg_order_value"] for r in customers.customer_stats(t).collect()}
    assert stats_ == {1: 7.0, 2: 0.0}


def test_catalogue_final_price_and_unsold(spark):
    menu = [(1, "Tea", "x" * 60, "drinks", D(10), D(2.5), "active"), (2, "Cake", "short", "food", D(5), D(0), "inactive")]
    t = make_tables(spark, users=[user(1)], orders=[order(1)], menu=menu, items=[item(1, 1, "menu", 1, qty=3)])
    rows = {r["id"]: r for r in catalogue.catalogue(t).collect()}
    assert rows[1]["final_price_formatted"] == "₹7.50" and rows[1]["times_ordered"] == 1
    assert rows[1]["total_quantity"] == 3 and rows[1]["description_short"] == "x" * 50 + "..."
    assert rows[2]["times_ordered"] == 0 and rows[2]["total_quantity"] is None
    assert rows[2]["status_badge"] == "danger"


def test_statistics_bundle_on_empty_period(spark):
    t = make_tables(spark, users=[user(1)], orders=[order(1, when=datetime(1999, 1, 1))])
    st = stats.order_statistics(t, "today", AS_OF)
    assert tuple(st.totals.first()) == (0, 0.0, 0.0)
    assert st.status_distribution.count() == 0 and st.orders_timeline.count() == 0


def test_statistics_bundle_keeps_null_status_group(spark):
    t = make_tables(spark, users=[user(1)], orders=[order(1, status=None), order(2), order(3)])
    st = stats.order_statistics(t, "all", AS_OF)
    assert {r["status"]: r["count"] for r in st.status_distribution.collect()} == {None: 1, "pending": 2}
    assert st.totals.first()["total_orders"] == 3


def test_jdbc_reader_requires_bounds_for_parallel_reads(spark):
    from orderlens.sources.tables import read_jdbc_table
    with pytest.raises(ValueError):
        read_jdbc_table(spark, "jdbc:postgresql://db/shop", "orders", {"user": "u"}, partition_column="order_id")


def test_flat_dossier_breaks_ties_as_the_header(spark):
    from pyspark.sql import functions as F

    from orderlens.operators import dossiers

    t = make_tables(spark, orders=[order(n, user_id=u) for n, u in ((1, 1), (2, 0), (3, None), (4, 9), (1, 1))], users=[user(1), user(1, "Bob"), user(0)],
                    payments=[(4, 1, D(7), "failed", "t1", "b"), (4, 1, D(7), "failed", "t0", "a"), (4, 1, D(9), "completed", "t2", None),
                              (None, 2, D(1), "pending", None, None), (3, 2, None, "failed", None, None)],
                    addresses=[(20, 1, True, "B", "S"), (20, 1, True, "A", "T"), (19, 1, False, "C", "S")])
    # a column before those that are returned breaks ties first
    t = t.with_tables(payments=t.payments.select("payment_id", "order_id", F.col("payment_status").alias("note"), *t.payments.columns[2:]))
    heads = dossiers.order_headers(t).select(
        "order_id", "item_count", "payment.payment_id", "payment.payment_status", F.col("payment.amount").alias("payment_amount"),
        F.col("customer.user.full_name").alias("customer_name"), F.col("customer.address.id").alias("default_address_id"),
        F.col("customer.address.city").alias("default_address_city"))
    flat = dossiers.order_dossier_flat(t).select(*heads.columns)
    got = sorted(map(str, flat.collect()))
    assert got == sorted(map(str, heads.collect())) and len(got) == 7
    assert flat.where("order_id = 1").select("payment_amount").distinct().collect() == [(D("9.00"),)]  # completed before failed


def test_ids_from_a_list_a_generator_and_a_table_give_equal_dossiers(spark):
    from orderlens.operators import dossiers
    from orderlens.sources.fixtures import shop_tables

    t = shop_tables(spark, "/root/testdata/sf0.001")
    ids = [r[0] for r in t.orders.select("order_id").orderBy("order_id").limit(3).collect()]
    want = sorted(map(str, dossiers.order_headers(t, ids).collect()))
    assert len(want) == 3
    assert sorted(map(str, dossiers.order_headers(t, (i for i in ids)).collect())) == want
    table = spark.createDataFrame([(i,) for i in ids], "order_id long")
    assert sorted(map(str, dossiers.order_headers(t, table).collect())) == want


def test_json_records_keep_microseconds_and_nulls(spark):
    import json

    from orderlens.functions.format import to_json_record

    row = spark.sql("SELECT timestamp_ntz'2001-07-31 01:02:03.456789' AS at, CAST(NULL AS STRING) AS payment")
    got = json.loads(row.select(to_json_record("at", "payment").alias("j")).first()["j"])
    assert got == {"at": "2001-07-31T01:02:03.456789", "payment": None}


def test_todays_orders_rejects_a_limit_below_one(spark):
    import pytest

    from orderlens.operators import orders
    from conftest import AS_OF, make_tables

    with pytest.raises(ValueError):
        orders.todays_orders(make_tables(spark), AS_OF, limit=0)
