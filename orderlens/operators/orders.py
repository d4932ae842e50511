"""V1, V2: today's orders and the searchable, paged order list with counts.

Plan shape for every list: filter orders (pushed into the scan), take the
ordered page as a top-k (TakeOrderedAndProject, no global sort), checkpoint
that page once, then count items for the page's keys only.  The page has at
most ``per_page`` rows, so its keys reach the item scan as a pushed ``IN``
filter (row-group statistics, bucket pruning) and the item table is never
shuffled whole.  ``item_count`` takes no part in filtering or ordering, so
counting after paging gives the reference's result.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.functions.predicates import (all_of, between, from_day, on_day, order_search, prune_months,
                                            status_is)
from orderlens.plans.joins import attach_counts, bounded_broadcast, restrict_to_keys
from orderlens.plans.lineage import materialize_bounded
from orderlens.plans.paging import check_page, check_size, keyset_page, newest_first, offset_page, sort_bounded
from orderlens.plans.selection import DEEP, deep_page
from orderlens.sources.search_index import SearchIndex
from orderlens.sources.tables import Tables

# Column lists of the reference's order lists.
TODAY_COLUMNS_LIVE = ["order_id", "user_name", "user_phone", "total_amount", "status", "order_date"]
TODAY_COLUMNS = ["order_id", "user_name", "user_phone", "total_amount", "payment_mode",
                 "delivery_location", "status", "order_date"]
LIST_COLUMNS_LIVE = ["order_id", "user_name", "user_phone", "user_email", "total_amount", "payment_mode",
                     "delivery_location", "status", "order_date"]
LIST_COLUMNS = LIST_COLUMNS_LIVE + ["delivery_date"]
TODAY_LIMIT = {"live": 20, "from": 50, "until_now": 50}


def newest() -> list:
    return newest_first("order_date", "order_id")


def item_counts_for(page: DataFrame, t: Tables, max_rows: int) -> DataFrame:
    """A1 + J1 for a bounded set of orders: ``COUNT(order_item_id)`` per order,
    0 when it has none, in the page's order.  The page is computed once; its
    keys reach the item scan as a pushed ``IN`` filter."""
    check_size(max_rows)
    page = materialize_bounded(page)
    counts = (restrict_to_keys(t.order_items.select("order_id", "order_item_id"), page, "order_id", max_rows)
              .groupBy("order_id").agg(F.count("order_item_id").alias("item_count")))
    return sort_bounded(attach_counts(page, bounded_broadcast(counts, max_rows), "order_id", "item_count"), newest())


def item_counts(t: Tables) -> DataFrame:
    """A1 over all orders: item count per order (0 for orders without items).

    Items are aggregated by ``order_id`` before the join (partial aggregation
    map-side), so the join sees one row per order on both sides.
    """
    counts = t.order_items.groupBy("order_id").agg(F.count("order_item_id").alias("item_count"))
    return attach_counts(t.orders.select("order_id"), counts, "order_id", "item_count")


def todays_orders(t: Tables, as_of: datetime, mode: str = "from", limit: int | None = None) -> DataFrame:
    """V1: newest orders of the as-of day with their item counts.

    ``mode``: ``live`` is ``DATE(order_date) = today`` (6 columns, top 20);
    ``from`` is ``DATE(order_date) >= today`` (8 columns, top 50);
    ``until_now`` is ``order_date BETWEEN midnight AND as_of`` (8 columns, top 50).
    """
    midnight = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    if mode == "live":
        pred, cols, months = on_day("order_date", as_of), TODAY_COLUMNS_LIVE, (midnight, midnight)
    elif mode == "from":
        pred, cols, months = from_day("order_date", as_of), TODAY_COLUMNS, (midnight, None)
    elif mode == "until_now":
        pred, cols, months = between("order_date", midnight, as_of), TODAY_COLUMNS, (midnight, as_of)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    n = TODAY_LIMIT[mode] if limit is None else limit
    if n < 1:
        raise ValueError(f"limit must be at least 1, not {n}")
    page = prune_months(t.orders.where(pred), *months).select(*cols).orderBy(*newest()).limit(n)
    return item_counts_for(page, t, n)


def filtered_orders(t: Tables, status: str | None = None, search: str | None = None,
                    index: SearchIndex | None = None) -> DataFrame:
    """The list's optional predicates, ANDed; with an ``index`` the
    search reads only the row groups of its candidates."""
    rows = t.orders if index is None else index.search(t.orders, search)
    return rows.where(all_of(status_is(status), order_search(search) if index is None else None))


def list_orders(t: Tables, page: int = 1, per_page: int = 20, status: str | None = None, search: str | None = None,
                live_columns: bool = False, after=None, index: SearchIndex | None = None) -> DataFrame:
    """V2: one page of orders, newest first, with item counts.

    ``after=(order_date, order_id)`` switches to keyset paging (``page`` is
    then ignored), which keeps deep pages as cheap as the first.  A page at an
    offset of ``DEEP`` rows or more is found by selecting its first key, so no
    task keeps the rows before it.
    """
    cols = LIST_COLUMNS_LIVE if live_columns else LIST_COLUMNS
    rows = filtered_orders(t, status, search, index).select(*cols)
    if after is not None:
        top = keyset_page(rows, "order_date", "order_id", per_page, after)
    else:
        deep = check_page(page, per_page) >= DEEP
        top = deep_page(rows, "order_date", "order_id", page, per_page) if deep else offset_page(rows, newest(), page, per_page)
    return item_counts_for(top, t, per_page)


def count_orders(t: Tables, status: str | None = None, search: str | None = None,
                 index: SearchIndex | None = None) -> DataFrame:
    """A10: number of orders matching the list's predicates (one row)."""
    return filtered_orders(t, status, search, index).agg(F.count(F.lit(1)).alias("total"))


def count_orders_distinct(t: Tables, status: str | None = None, search: str | None = None) -> DataFrame:
    """``COUNT(DISTINCT order_id)`` with the same predicates."""
    return filtered_orders(t, status, search).agg(F.count_distinct("order_id").alias("total"))


def with_display(page: DataFrame, t: Tables, max_rows: int = 20) -> DataFrame:
    """The order list as the page shows it (D8): payment status joined from
    ``payments`` (lowest payment id; 'pending' when none), badges, and
    formatted amount and date.  ``page`` is a bounded page (<= ``max_rows``),
    so its keys reach the payments scan as a pushed ``IN`` filter."""
    from orderlens.functions import format as fmt
    from orderlens.plans.joins import pick_one

    check_size(max_rows)
    page = materialize_bounded(page)
    pays = pick_one(restrict_to_keys(t.payments, page, "order_id", max_rows), "order_id", ["payment_id"], "_pay")
    out = page.join(bounded_broadcast(pays, max_rows), "order_id", "left")
    out = (out.withColumn("payment_status", fmt.or_default(F.col("_pay.payment_status"), "pending"))
            .drop("_pay")
            .withColumn("status_badge", fmt.status_badge("status"))
            .withColumn("payment_badge", fmt.payment_badge("payment_status"))
            .withColumn("total_amount_formatted", fmt.currency("total_amount"))
            .withColumn("order_date_formatted", fmt.datetime_text("order_date")))
    return sort_bounded(out, newest())
