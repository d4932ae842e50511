"""The item catalogue (services and menu) with sales figures.

Sales are aggregated from ``order_items`` by ``(item_type, item_id)`` before
the join (partial aggregation: a best-seller holding a third of all lines is
one row per map task), so the join pairs one catalogue row with at most one
sales row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions import format as fmt
from orderlens.functions.predicates import search_any
from orderlens.sources.tables import MONEY, Tables

# Catalogue tabs and their item_type tag.
CATALOGUE_TYPES = {"service": "services", "menu": "menu"}
DESCRIPTION_CHARS = 50


def item_sales(t: Tables) -> DataFrame:
    """Times ordered (order lines) and units sold per catalogue item."""
    return (t.order_items.groupBy("item_type", F.col("item_id").alias("id"))
            .agg(F.count(F.lit(1)).alias("times_ordered"), F.sum("quantity").alias("total_quantity")))


def catalogue_items(t: Tables) -> DataFrame:
    """Services and menu under one ``item_type`` column."""
    parts = []
    for item_type, attr in CATALOGUE_TYPES.items():
        df = getattr(t, attr).withColumn("item_type", F.lit(item_type))
        if "photo_url" not in df.columns:
            df = df.withColumn("photo_url", F.lit(None).cast(T.StringType()))
        parts.append(df)
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def catalogue(t: Tables, item_type: str | None = None, search: str | None = None) -> DataFrame:
    """Catalogue rows with display fields and sales.

    ``final_price`` is ``price - discount`` (M4); ``times_ordered`` is 0 and
    ``total_quantity`` NULL for items never ordered.
    """
    items = catalogue_items(t)
    if item_type:
        items = items.where(F.col("item_type") == item_type)
    pred = search_any(search, [F.col("name")])
    if pred is not None:
        items = items.where(pred)
    out = items.join(item_sales(t), ["item_type", "id"], "left")
    discount = F.coalesce(F.col("discount"), F.lit(0).cast(MONEY))
    return out.select(
        "item_type", "id", "name", "category", "status",
        fmt.image_url("photo_url").alias("photo_url"),
        fmt.truncate("description", DESCRIPTION_CHARS).alias("description_short"),
        "price", "discount",
        (F.col("price") - discount).alias("final_price"),
        fmt.currency("price").alias("price_formatted"),
        fmt.currency("discount").alias("discount_formatted"),
        fmt.currency(F.col("price") - discount).alias("final_price_formatted"),
        (discount > 0).alias("has_discount"),
        F.coalesce("times_ordered", F.lit(0).cast("bigint")).alias("times_ordered"),
        "total_quantity",
        F.when(F.col("status") == "active", F.lit("success")).otherwise(F.lit("danger")).alias("status_badge"),
    )
