"""Hourly roll-up of orders, kept by additions and retractions.

The roll-up has one row per (hour of ``order_date``, status): number of orders,
number of amounts that are not NULL, their sum.  It lives in a tiered store:
batch 0 holds the orders there were, later batches bring new orders, or status
changes as pairs of rows, one that takes the order out of its old status and one
that puts it into its new one.

Figures of a period add up the whole hours inside it, a few thousand rows
however many orders there are, and the orders of its first and last hour where
the period's ends cut an hour: two hours of orders at most, with pushed range
filters.  Orders without a date are in no period, so they are not rolled up.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions.period import period_bounds, timeline_unit, ts_lit
from orderlens.functions.predicates import prune_months
from orderlens.operators.stats import bucket
from orderlens.plans.joins import restrict_to_key_range
from orderlens.sources.tiered_store import FANOUT, TieredStore

SCHEMA = T.StructType([T.StructField("hour", T.TimestampNTZType()), T.StructField("status", T.StringType()),
                       T.StructField("orders", T.LongType()), T.StructField("amounts", T.LongType()),
                       T.StructField("revenue", T.DecimalType(38, 2))])
MICROSECOND = timedelta(microseconds=1)


def rollup_store(spark: SparkSession, root: str, fanout: int = FANOUT) -> TieredStore:
    return TieredStore(spark, root, SCHEMA, ("hour", "status"), fanout)


def _sums(rows: DataFrame, sign: int = 1) -> DataFrame:
    """Roll-up rows of orders, or of orders taken back (``sign`` -1)."""
    s = F.lit(sign)
    return rows.where(F.col("order_date").isNotNull()).groupBy(bucket("order_date", "hour").alias("hour"), "status").agg(
        F.sum(s).cast("long").alias("orders"),
        (F.count("total_amount") * s).cast("long").alias("amounts"),
        (F.coalesce(F.sum("total_amount"), F.lit(0)) * s).cast("decimal(38,2)").alias("revenue"))


def add_orders(store: TieredStore, batch_id: int, orders: DataFrame) -> None:
    """Commit new orders as one batch."""
    store.write(batch_id, _sums(orders))


def change_statuses(store: TieredStore, batch_id: int, orders_before: DataFrame, changes: DataFrame) -> None:
    """Commit status changes ``(order_id, status)``, one per order, as one batch:
    each order leaves its status before and enters the new one.  Changes that name
    no order change nothing."""
    touched = restrict_to_key_range(orders_before.select("order_id", "order_date", "total_amount", "status"), changes, "order_id")
    both = touched.join(changes.select("order_id", F.col("status").alias("_new")), "order_id")
    store.write(batch_id, _sums(both, -1).unionByName(_sums(both.drop("status").withColumnRenamed("_new", "status"))))


def _hour(d: datetime) -> datetime:
    return d.replace(minute=0, second=0, microsecond=0)


def cut_hours(start: datetime, end: datetime) -> tuple[datetime, datetime, list[tuple[datetime, datetime]]]:
    """``(first, last, edges)`` of the inclusive period: whole hours from
    ``first`` up to and without ``last``, and what is left at its ends as
    inclusive ranges within one hour each."""
    if end < start:
        return start, start, []
    past = end + MICROSECOND if end < datetime.max else end
    first = _hour(start) if start == _hour(start) else _hour(start) + timedelta(hours=1)
    last = _hour(past)
    if last < first:  # inside one hour
        return first, first, [(start, end)]
    edges = [(start, first - MICROSECOND)] if start < first else []
    if last < past:
        edges.append((last, end))
    return first, last, edges


def edge_orders(orders: DataFrame, edges: list[tuple[datetime, datetime]]) -> DataFrame:
    """The orders of the cut hours."""
    rows = None
    for start, end in edges:
        part = prune_months(orders.where(F.col("order_date").between(ts_lit(start), ts_lit(end))), start, end)
        part = part.select("order_date", "total_amount", "status")
        rows = part if rows is None else rows.unionByName(part)
    return orders.select("order_date", "total_amount", "status").where(F.lit(False)) if rows is None else rows


def period_sums(store: TieredStore, orders: DataFrame, period: str, as_of: datetime) -> DataFrame:
    """Roll-up rows (hour, status, orders, amounts, revenue) of the period.
    ``orders`` are the orders as the store's last batch left them."""
    first, last, edges = cut_hours(*period_bounds(period, as_of))
    whole = store.read().where((F.col("hour") >= ts_lit(first)) & (F.col("hour") < ts_lit(last)))
    return whole.unionByName(_sums(edge_orders(orders, edges)))


def _money(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def totals(store: TieredStore, orders: DataFrame, period: str, as_of: datetime) -> DataFrame:
    """A3 from the roll-up: orders, revenue and average order value (one row)."""
    count = F.sum("amounts")
    return period_sums(store, orders, period, as_of).agg(
        F.coalesce(F.sum("orders"), F.lit(0)).cast("long").alias("total_orders"), _money(F.sum("revenue")).alias("total_revenue"),
        F.coalesce(F.try_divide(F.sum("revenue").cast("double"), count.cast("double")), F.lit(0.0)).alias("avg_order_value"))


def status_distribution(store: TieredStore, orders: DataFrame, period: str, as_of: datetime) -> DataFrame:
    """A6 from the roll-up: orders per status, without statuses that all orders have left."""
    return (period_sums(store, orders, period, as_of).groupBy("status").agg(F.sum("orders").alias("count"))
            .where(F.col("count") != 0))


def timeline(store: TieredStore, orders: DataFrame, period: str, as_of: datetime, unit: str | None = None) -> DataFrame:
    """A7 from the roll-up: orders and revenue per bucket, in time order."""
    rows = period_sums(store, orders, period, as_of)
    return (rows.groupBy(bucket("hour", unit or timeline_unit(period)).alias("period"))
            .agg(F.sum("orders").alias("order_count"), _money(F.sum("revenue")).alias("total_revenue"))
            .where(F.col("order_count") != 0).orderBy(F.asc_nulls_first("period")))
