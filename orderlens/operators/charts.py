"""V9: chart-ready series (timeline, top items, status) as DataFrames.

Inputs are already aggregated figures (one row per bucket, item or status),
so every frame here is small by construction; positions are numbered with a
window over those few rows only, after the cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions import format as fmt

# The reference's chart cuts.
MAX_TIMELINE_POINTS = 20
MAX_ITEMS = 10
LABEL_CHARS = 20


def _numbered(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def chart_timeline(timeline: DataFrame, max_points: int | None = MAX_TIMELINE_POINTS) -> DataFrame:
    """Labels, order counts and revenue per bucket.

    Timestamp buckets are labelled ``dd MMM hh:mm a``; day buckets print as
    ``yyyy-MM-dd``.  The cut keeps the EARLIEST ``max_points`` buckets, as the
    reference does (``None`` keeps all).
    """
    is_date = isinstance(timeline.schema["period"].dataType, T.DateType)
    label = (F.col("period").cast("string") if is_date
             else fmt.format_ntz("period", fmt.CHART_LABEL_FORMAT))
    rows = timeline.orderBy(F.asc_nulls_first("period"))
    if max_points is not None:
        rows = rows.limit(max_points)
    out = rows.select("period", F.coalesce(label, F.lit("None")).alias("label"),
                      F.col("order_count").alias("orders"),
                      F.coalesce(F.col("total_revenue").cast("double"), F.lit(0.0)).alias("revenue"))
    return _numbered(out, F.asc_nulls_first("period")).drop("period")


def chart_items(top_items: DataFrame, max_items: int | None = MAX_ITEMS) -> DataFrame:
    """Item labels cut to 20 characters, units and revenue, in top order."""
    order = [F.desc("total_quantity"), F.asc_nulls_last("item_name"), F.asc_nulls_last("item_type")]
    rows = top_items.orderBy(*order)
    if max_items is not None:
        rows = rows.limit(max_items)
    name = F.coalesce(F.col("item_name"), F.lit("Unknown"))
    out = rows.select("item_name", "item_type", "total_quantity",
                      fmt.truncate(name, LABEL_CHARS).alias("label"),
                      F.col("total_quantity").alias("quantities"),
                      F.coalesce(F.col("total_revenue").cast("double"), F.lit(0.0)).alias("revenues"))
    return _numbered(out, *order).drop("item_name", "item_type", "total_quantity")


def chart_status(distribution: DataFrame) -> DataFrame:
    """Title-cased status labels, counts and colours (unknown statuses grey)."""
    label = fmt.title_case(F.coalesce(F.col("status"), F.lit("unknown")))
    out = distribution.select("status", label.alias("label"), F.col("count").alias("value"))
    out = out.withColumn("color", fmt.status_color(F.col("label")))
    return _numbered(out, F.asc_nulls_first("status")).drop("status")


def chart_series(statistics) -> dict[str, DataFrame]:
    """V9: the three chart frames from an ``OrderStatistics`` bundle."""
    return {"timeline": chart_timeline(statistics.orders_timeline),
            "items": chart_items(statistics.top_items),
            "status": chart_status(statistics.status_distribution)}
