"""V4, V5: customer list with lifetime metrics, and customer dossiers.

Orders are always aggregated by ``user_id`` BEFORE meeting ``users`` (the
reference joins first and groups by the user key): the partial aggregate
turns a customer with a third of all orders into one row per map task, and
the join then sees one row per user on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.predicates import customer_search
from orderlens.operators.stats import money_avg, money_sum
from orderlens.plans.joins import bounded_broadcast, restrict_to_keys
from orderlens.plans.lineage import materialize_bounded
from orderlens.plans.paging import check_page, keyset_page, offset_page, sort_bounded
from orderlens.plans.selection import DEEP, deep_page
from orderlens.sources.search_index import SearchIndex
from orderlens.sources.tables import Tables

RECENT_ORDERS = 10


def newest_users() -> list:
    """Postgres ``created_at DESC`` (NULLs first) plus the id as tiebreaker."""
    return [F.desc_nulls_first("created_at"), F.desc("id")]


def _lifetime(orders: DataFrame, with_avg: bool = False) -> DataFrame:
    aggs = [F.count("order_id").alias("total_orders"),
            money_sum("total_amount").alias("total_spent")]
    if with_avg:
        aggs.append(money_avg("total_amount").alias("avg_order_value"))
    else:
        aggs.append(F.max("order_date").alias("last_order_date"))
    return orders.groupBy("user_id").agg(*aggs)


def _attach(users: DataFrame, metrics: DataFrame) -> DataFrame:
    """Left join user rows to per-user metrics; users without orders get zeros."""
    m = metrics.withColumnRenamed("user_id", "id")
    out = users.join(m, "id", "left")
    out = out.withColumn("total_orders", F.coalesce("total_orders", F.lit(0).cast("bigint")))
    out = out.withColumn("total_spent", F.coalesce("total_spent", F.lit(0.0)))
    if "avg_order_value" in m.columns:
        out = out.withColumn("avg_order_value", F.coalesce("avg_order_value", F.lit(0.0)))
    return out


def customer_metrics(t: Tables) -> DataFrame:
    """A2 + J2 over all users: orders, spend and last order date per user."""
    return _attach(t.users, _lifetime(t.user_orders.select("user_id", "order_id", "total_amount", "order_date")))


def filtered_users(t: Tables, search: str | None = None, index: SearchIndex | None = None) -> DataFrame:
    if index is not None:
        return index.search(t.users, search)
    pred = customer_search(search)
    return t.users.where(pred) if pred is not None else t.users


def list_customers(t: Tables, page: int = 1, per_page: int = 20, search: str | None = None,
                   after=None, index: SearchIndex | None = None) -> DataFrame:
    """V4: a page of users, newest first, with lifetime metrics.

    The page is taken from ``users`` alone (metrics take no part in filtering
    or ordering), then only that page's orders are aggregated: the page's ids
    reach the orders scan as a pushed ``IN`` filter.  ``after=(created_at,
    id)`` switches to keyset paging (``page`` is then ignored); a page at an
    offset of ``DEEP`` rows or more is found by selecting its first key.
    """
    if after is not None:
        top = keyset_page(filtered_users(t, search, index), "created_at", "id", per_page, after)
    else:
        rows, deep = filtered_users(t, search, index), check_page(page, per_page) >= DEEP
        top = deep_page(rows, "created_at", "id", page, per_page) if deep else offset_page(rows, newest_users(), page, per_page)
    top = materialize_bounded(top)
    orders = restrict_to_keys(t.user_orders.select("user_id", "order_id", "total_amount", "order_date"),
                              top, "user_id", per_page, key_col="id")
    metrics = bounded_broadcast(_lifetime(orders), per_page)
    return sort_bounded(_attach(top, metrics), newest_users())


def count_customers(t: Tables, search: str | None = None) -> DataFrame:
    """A10 for users: count of users matching the search (one row)."""
    return filtered_users(t, search).agg(F.count(F.lit(1)).alias("total"))


def customer_stats(t: Tables) -> DataFrame:
    """A12 for every user: order count, spend and average order value, zeros
    for users without orders."""
    metrics = _lifetime(t.user_orders.select("user_id", "order_id", "total_amount"), with_avg=True)
    return _attach(t.users.select("id"), metrics).withColumnRenamed("id", "user_id")


def recent_orders(t: Tables, n: int = RECENT_ORDERS) -> DataFrame:
    """W2 + J12: each user's last ``n`` orders, newest first, with their rank.

    ``row_number() <= n`` is planned with a partial WindowGroupLimit before
    the shuffle: each map task forwards at most ``n`` rows per user, so a user
    with a third of all orders costs ``n`` rows per task, not the whole group.
    """
    w = Window.partitionBy("user_id").orderBy(F.desc_nulls_first("order_date"), F.desc("order_id"))
    ranked = t.user_orders.where(F.col("user_id").isNotNull()).withColumn("recent_rank", F.row_number().over(w))
    return ranked.where(F.col("recent_rank") <= n)


def addresses_ranked(t: Tables) -> DataFrame:
    """J8 + O7: every address with its place in the user's list: default
    first (Postgres ``is_default DESC``: NULL, then true, then false), then id.
    The position is a sort key, not a window rank, so no user's addresses
    have to meet in one task."""
    rank = (F.when(F.col("is_default").isNull(), F.lit(0))
            .when(F.col("is_default"), F.lit(1)).otherwise(F.lit(2)))
    return t.addresses.withColumn("default_rank", rank)


def with_display(page: DataFrame) -> DataFrame:
    """The customer list as the page shows it (V4 route formatting):
    formatted dates and spend, location text, active flag and defaults."""
    from orderlens.functions import format as fmt

    return (page.withColumn("created_at_formatted", fmt.datetime_text(F.col("created_at").cast("timestamp_ntz")))
            .withColumn("last_order_date_formatted", fmt.datetime_text("last_order_date"))
            .withColumn("total_spent_formatted", fmt.currency("total_spent"))
            .withColumn("location", fmt.location_text("city", "state"))
            .withColumn("active_text", fmt.active_text("is_active"))
            .withColumn("last_order_text", F.when(F.col("total_orders") > 0, F.col("last_order_date_formatted"))
                        .otherwise(F.lit("No orders"))))
