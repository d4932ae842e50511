"""V6-V8: period statistics, dashboard figures and global KPIs.

All figures are DataFrames; callers collect the (small) results.  Shapes:

* totals: one row even for an empty period (global aggregate).
* top items: top-k of an aggregate, planned as partial/final HashAggregate
  plus TakeOrderedAndProject (no global sort).
* status distribution and timeline: one row per group, NULL status included.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.functions.format import currency
from orderlens.functions.period import timeline_unit
from orderlens.functions.predicates import in_period, on_day, prune_months
from orderlens.plans.joins import restrict_to_key_range
from orderlens.sources.tables import MONEY, Tables

# Periods short enough that pushing their order-id range into the item scan
# pays for the one-row bounds query.
SHORT_PERIODS = ("today", "yesterday", "week", "month", "last_month")


def money_sum(col: str | Column) -> Column:
    """``COALESCE(SUM(x), 0)`` summed exactly in decimal, shown as double."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.sum(c).cast("double"), F.lit(0.0))


def money_avg(col: str | Column) -> Column:
    """``COALESCE(AVG(x), 0)`` as exact decimal sum / count of non-NULL values."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double")), F.lit(0.0))


def _totals_aggs() -> list[Column]:
    return [F.count(F.lit(1)).alias("total_orders"),
            money_sum("total_amount").alias("total_revenue"),
            money_avg("total_amount").alias("avg_order_value")]


def totals(t: Tables, period: str, as_of: datetime) -> DataFrame:
    """A3: orders, revenue and average order value inside the period."""
    return in_period(t.orders, period, as_of).agg(*_totals_aggs())


def today_totals(t: Tables, as_of: datetime) -> DataFrame:
    """A4: the dashboard's whole-day totals (``DATE(order_date) = today``)."""
    day = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    return prune_months(t.orders.where(on_day("order_date", as_of)), day, day).agg(*_totals_aggs())


def top_items(t: Tables, period: str, as_of: datetime, limit: int | None = 10) -> DataFrame:
    """A5 + O4: items by units sold among orders of the period.

    Orders enter only as a key set (semi join), so just ``order_id`` is
    shuffled from that side; for a short period AQE turns the join into a
    broadcast from the runtime size.  The aggregate is partial before the
    shuffle, so a best-seller holding a third of all lines costs one row per
    map task.  Ties are broken by name, then type.  For short periods the
    item scan also gets the period's ``order_id`` range as a pushed filter.
    """
    keys = in_period(t.orders.select("order_id", "order_date"), period, as_of).select("order_id")
    items = t.order_items
    if period in SHORT_PERIODS:
        items = restrict_to_key_range(items, keys, "order_id")
    lines = items.join(keys, "order_id", "left_semi")
    agg = lines.groupBy("item_name", "item_type").agg(
        F.coalesce(F.sum("quantity"), F.lit(0)).cast("bigint").alias("total_quantity"),
        money_sum("total").alias("total_revenue"),
    )
    ordered = agg.orderBy(F.desc("total_quantity"), F.asc_nulls_last("item_name"), F.asc_nulls_last("item_type"))
    return ordered.limit(limit) if limit is not None else ordered


def with_avg_price(items: DataFrame) -> DataFrame:
    """Revenue / units, 0 when no units (never a division by zero)."""
    return items.withColumn(
        "avg_price",
        F.when(F.col("total_quantity") > 0,
               F.col("total_revenue") / F.col("total_quantity").cast("double")).otherwise(F.lit(0.0)),
    ).withColumn("avg_price_formatted", currency("avg_price"))


def best_seller(t: Tables, period: str, as_of: datetime) -> DataFrame:
    """Name of the top item, 'N/A' when the period sold nothing.

    One row always: the top-1 (at most one row) goes through a global
    aggregate, which yields a row even when the period is empty.
    """
    top = top_items(t, period, as_of, limit=1)
    return top.agg(F.coalesce(F.first("item_name"), F.lit("N/A")).alias("best_seller"))


def status_distribution(t: Tables, period: str, as_of: datetime) -> DataFrame:
    """Orders per status; NULL status is its own group."""
    return (in_period(t.orders.select("status", "order_date"), period, as_of)
            .groupBy("status").agg(F.count(F.lit(1)).alias("count")))


def status_share(dist: DataFrame) -> DataFrame:
    """Whole-percent share of each status, ``Math.round(n / total * 100)``.

    The input has one row per distinct status (a handful), so the unpartitioned
    window runs over a tiny relation.
    """
    total = F.sum("count").over(Window.partitionBy())
    share = F.floor(F.col("count").cast("double") / total.cast("double") * 100.0 + 0.5)
    return dist.withColumn("percentage", share.cast("bigint"))


def bucket(col: str, unit: str) -> Column:
    """Hour, day or month bucket of a ``timestamp_ntz`` column.

    Day buckets are DATEs (``DATE(x)``); hour and month buckets stay
    ``timestamp_ntz``.  Built from date parts, so no session zone is involved.
    """
    c = F.col(col)
    if unit == "day":
        return F.to_date(c)
    if unit == "hour":
        return F.make_timestamp_ntz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.lit(0), F.lit(0))
    if unit == "month":
        return F.make_timestamp_ntz(F.year(c), F.month(c), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    raise ValueError(f"unknown bucket unit {unit!r}")


def timeline(t: Tables, period: str, as_of: datetime, unit: str | None = None) -> DataFrame:
    """A7 + O9: orders and revenue per bucket, in time order; empty buckets
    are not filled."""
    unit = unit or timeline_unit(period)
    rows = in_period(t.orders.select("order_date", "total_amount"), period, as_of)
    return (rows.groupBy(bucket("order_date", unit).alias("period"))
            .agg(F.count(F.lit(1)).alias("order_count"), money_sum("total_amount").alias("total_revenue"))
            .orderBy(F.asc_nulls_first("period")))


@dataclass(frozen=True)
class OrderStatistics:
    totals: DataFrame
    top_items: DataFrame
    status_distribution: DataFrame
    orders_timeline: DataFrame


def period_figures(t: Tables, period: str, as_of: datetime, unit: str | None = None) -> DataFrame:
    """Totals, per-status and per-bucket figures of a period in ONE pass.

    ``GROUPING SETS ((status), (period), ())`` over the period's orders: one
    scan and one shuffle instead of three.  ``gid`` tells the sets apart
    (1: per status, 2: per bucket, 3: total), so a NULL status stays a group
    of its own.  The result has (statuses + buckets + 1) rows.
    """
    unit = unit or timeline_unit(period)
    rows = (in_period(t.orders.select("status", "order_date", "total_amount"), period, as_of)
            .withColumn("period", bucket("order_date", unit)))
    return rows.groupingSets([["status"], ["period"], []], "status", "period").agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("n"),
        money_sum("total_amount").alias("revenue"),
        money_avg("total_amount").alias("avg"),
    )


def order_statistics(t: Tables, period: str, as_of: datetime, single_pass: bool = True) -> OrderStatistics:
    """V6: the four figures of the statistics page for one period.

    With ``single_pass`` the three order figures come from one grouping-sets
    aggregate, checkpointed once (it is small: one row per status and per
    bucket) and split; top items read the item table separately.
    """
    if not single_pass:
        return OrderStatistics(
            totals=totals(t, period, as_of),
            top_items=top_items(t, period, as_of),
            status_distribution=status_distribution(t, period, as_of),
            orders_timeline=timeline(t, period, as_of),
        )
    from orderlens.plans.lineage import materialize_bounded

    fig = materialize_bounded(period_figures(t, period, as_of))
    gid = F.col("gid")
    # the () set yields no row on an empty period; a global aggregate over it
    # always yields exactly one
    total = fig.where(gid == 3).agg(
        F.coalesce(F.max("n"), F.lit(0).cast("bigint")).alias("total_orders"),
        F.coalesce(F.max("revenue"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(F.max("avg"), F.lit(0.0)).alias("avg_order_value"))
    return OrderStatistics(
        totals=total,
        top_items=top_items(t, period, as_of),
        status_distribution=fig.where(gid == 1).select("status", F.col("n").alias("count")),
        orders_timeline=(fig.where(gid == 2)
                         .select("period", F.col("n").alias("order_count"), F.col("revenue").alias("total_revenue"))
                         .orderBy(F.asc_nulls_first("period"))),
    )


def _orders_and_users(t: Tables) -> DataFrame:
    """Orders and users as one tagged relation, so figures over both tables
    come from a single aggregate (two scans, one partial/final aggregation,
    no join)."""
    o = t.orders.select(
        F.lit(True).alias("is_order"), "order_date", "total_amount", "status",
        F.lit(None).cast("date").alias("created_at"))
    u = t.users.select(
        F.lit(False).alias("is_order"), F.lit(None).cast("timestamp_ntz").alias("order_date"),
        F.lit(None).cast(MONEY).alias("total_amount"), F.lit(None).cast("string").alias("status"),
        F.col("created_at").cast("date").alias("created_at"))
    return o.unionByName(u)


def dashboard_kpis(t: Tables, as_of: datetime) -> DataFrame:
    """V7 figures: today's totals (whole day), pending orders (all time) and
    users created today, in one row."""
    rows = _orders_and_users(t)
    is_order = F.col("is_order")
    today = is_order & on_day("order_date", as_of)
    amount_today = F.when(today, F.col("total_amount"))
    return rows.agg(
        F.count_if(today).alias("today_orders"),
        money_sum(amount_today).alias("today_revenue"),
        money_avg(amount_today).alias("today_avg_order_value"),
        F.count_if(is_order & (F.col("status") == "pending")).alias("pending_orders"),
        F.count_if(~is_order & on_day("created_at", as_of)).alias("new_customers"),
    )


def dashboard_top(t: Tables, as_of: datetime, n: int = 5) -> DataFrame:
    """The dashboard's top items of today, names cut to 20 characters."""
    from orderlens.functions.format import truncate

    return (top_items(t, "today", as_of, limit=n)
            .withColumn("item_label", truncate("item_name", 20)))


def admin_kpis(t: Tables) -> DataFrame:
    """All-time orders, revenue, customers and pending orders in one
    pass over both tables."""
    rows = _orders_and_users(t)
    is_order = F.col("is_order")
    out = rows.agg(
        F.count_if(is_order).alias("total_orders"),
        money_sum(F.when(is_order, F.col("total_amount"))).alias("total_revenue_amount"),
        F.count_if(~is_order).alias("total_customers"),
        F.count_if(is_order & (F.col("status") == "pending")).alias("pending_orders"),
    )
    return out.withColumn("total_revenue", currency("total_revenue_amount"))


def pending_orders(t: Tables) -> DataFrame:
    """Pending orders of all time."""
    return t.orders.agg(F.count_if(F.col("status") == "pending").alias("pending"))


def new_users_on(t: Tables, as_of: datetime) -> DataFrame:
    """Users created on the as-of day."""
    return t.users.agg(F.count_if(on_day("created_at", as_of)).alias("new_customers"))


@dataclass(frozen=True)
class Dashboard:
    kpis: DataFrame
    todays_orders: DataFrame
    top_items: DataFrame
    statistics: OrderStatistics


def dashboard(t: Tables, as_of: datetime) -> Dashboard:
    """V7: everything the dashboard shows, as DataFrames (figures in one row,
    today's orders, top 5 items of today, and today's statistics)."""
    from orderlens.operators.orders import todays_orders

    return Dashboard(kpis=dashboard_kpis(t, as_of), todays_orders=todays_orders(t, as_of, "live"),
                     top_items=dashboard_top(t, as_of), statistics=order_statistics(t, "today", as_of))
