"""The shop tables as DataFrames, and the readers/writers for them.

Every operator takes a :class:`Tables` bundle.  The bundle only holds lazy
DataFrames: nothing is read until an action runs, so Catalyst prunes the
columns and pushes the filters of each query into the scans.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from orderlens.sources.optional import read_parquet_if_present

MONEY = T.DecimalType(18, 2)

# Column contracts of the shop tables (names and Spark types the operators
# read).  Extra columns are carried along by the ``*`` projections.
SCHEMAS: dict[str, T.StructType] = {
    "orders": T.StructType([
        T.StructField("order_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("user_name", T.StringType()),
        T.StructField("user_phone", T.StringType()),
        T.StructField("user_email", T.StringType()),
        T.StructField("total_amount", MONEY),
        T.StructField("payment_mode", T.StringType()),
        T.StructField("delivery_location", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("order_date", T.TimestampNTZType()),
        T.StructField("delivery_date", T.TimestampNTZType()),
    ]),
    "order_items": T.StructType([
        T.StructField("order_item_id", T.LongType()),
        T.StructField("order_id", T.LongType()),
        T.StructField("item_type", T.StringType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("item_name", T.StringType()),
        T.StructField("quantity", T.LongType()),
        T.StructField("total", MONEY),
        T.StructField("price", MONEY),
    ]),
    "users": T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("full_name", T.StringType()),
        T.StructField("phone", T.StringType()),
        T.StructField("email", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("is_active", T.BooleanType()),
        T.StructField("created_at", T.DateType()),
    ]),
    "addresses": T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("is_default", T.BooleanType()),
        T.StructField("city", T.StringType()),
        T.StructField("state", T.StringType()),
    ]),
    "payments": T.StructType([
        T.StructField("payment_id", T.LongType()),
        T.StructField("order_id", T.LongType()),
        T.StructField("amount", MONEY),
        T.StructField("payment_status", T.StringType()),
        T.StructField("transaction_id", T.StringType()),
        T.StructField("razorpay_signature", T.StringType()),
    ]),
    "services": T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("price", MONEY),
        T.StructField("discount", MONEY),
        T.StructField("status", T.StringType()),
    ]),
    "order_logs": T.StructType([
        T.StructField("log_id", T.LongType()),
        T.StructField("order_id", T.LongType()),
        T.StructField("admin_id", T.LongType()),
        T.StructField("action", T.StringType(), nullable=False),
        T.StructField("details", T.StringType()),
        T.StructField("old_status", T.StringType()),
        T.StructField("new_status", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]),
    "status_updates": T.StructType([
        T.StructField("update_id", T.LongType()),
        T.StructField("order_id", T.LongType()),
        T.StructField("new_status", T.StringType()),
        T.StructField("admin_id", T.LongType()),
        T.StructField("notes", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
    ]),
}
SCHEMAS["menu"] = SCHEMAS["services"]


@dataclass(frozen=True)
class Tables:
    """The shop's tables.  ``order_logs`` and ``status_updates`` may be absent."""

    orders: DataFrame
    order_items: DataFrame
    users: DataFrame
    addresses: DataFrame
    payments: DataFrame
    services: DataFrame
    menu: DataFrame
    order_logs: DataFrame | None = None
    status_updates: DataFrame | None = None
    # optional second copy of ``orders`` laid out by ``user_id`` (bucketed),
    # used by the per-customer operators when present
    orders_by_user: DataFrame | None = None

    @property
    def user_orders(self) -> DataFrame:
        """Orders for per-user access: the user-bucketed copy if present."""
        return self.orders_by_user if self.orders_by_user is not None else self.orders

    def with_tables(self, **changes: DataFrame) -> "Tables":
        return replace(self, **changes)

    def names(self) -> list[str]:
        return [f.name for f in fields(self) if getattr(self, f.name) is not None]


def empty_logs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS["order_logs"])


def read_parquet_tables(spark: SparkSession, root: str) -> Tables:
    """Read ``{root}/{table}`` parquet datasets (folders or single files).

    Parquet gives pushed filters, pruned columns and, for datasets written with
    :func:`write_tables`, partition pruning on ``order_month``.
    """
    def read(name: str, required: bool = True) -> DataFrame | None:
        path = f"{root.rstrip('/')}/{name}"
        return spark.read.parquet(path) if required else read_parquet_if_present(spark, path)

    return Tables(
        orders=read("orders"), order_items=read("order_items"), users=read("users"),
        addresses=read("addresses"), payments=read("payments"), services=read("services"),
        menu=read("menu"), order_logs=read("order_logs", False), status_updates=read("status_updates", False),
        orders_by_user=read("orders_by_user", False),
    )


def read_jdbc_table(spark: SparkSession, url: str, table: str, properties: dict[str, str],
                    partition_column: str | None = None, lower: int | None = None,
                    upper: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """Read one shop table over JDBC (e.g. from the shop's Postgres).

    Large tables must be read in parallel: give ``partition_column`` (a numeric
    key such as ``order_id``) with its bounds so Spark issues ``num_partitions``
    range queries instead of one.  The JDBC driver jar must be on the classpath.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for key, value in properties.items():
        reader = reader.option(key, value)
    if partition_column is not None:
        if lower is None or upper is None or not num_partitions:
            raise ValueError("partitioned JDBC read needs lower, upper and num_partitions")
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", lower)
                  .option("upperBound", upper).option("numPartitions", num_partitions))
    return reader.load()


def write_tables(tables: Tables, root: str, mode: str = "errorifexists",
                 num_partitions: int | None = None, max_records_per_file: int = 5_000_000) -> None:
    """Write the bundle as parquet, laid out for the operators' access paths.

    ``orders`` is partitioned by month of ``order_date`` so period filters prune
    whole folders.  Rows are range-partitioned on ``(order_month, order_id)``
    before the write: a busy month is spread over many tasks (never one task
    per month) and every file holds a sorted ``order_id`` range, so row-group
    statistics skip data for key lookups.  Child tables are range-partitioned
    on their parent key for the same reason.  ``max_records_per_file`` bounds
    file size.
    """
    from pyspark.sql import functions as F

    spark = tables.orders.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = root.rstrip("/")
    orders = tables.orders.withColumn("order_month", F.substring(F.col("order_date").cast("string"), 1, 7))
    (orders.repartitionByRange(n, "order_month", "order_id").sortWithinPartitions("order_month", "order_id")
     .write.mode(mode).option("maxRecordsPerFile", max_records_per_file)
     .partitionBy("order_month").parquet(f"{base}/orders"))
    by_key = {"order_items": "order_id", "payments": "order_id", "addresses": "user_id",
              "users": "id", "services": "id", "menu": "id", "order_logs": "order_id",
              "status_updates": "order_id", "orders_by_user": "user_id"}
    for name in tables.names():
        if name == "orders":
            continue
        df = getattr(tables, name)
        (df.repartitionByRange(n, by_key[name]).sortWithinPartitions(by_key[name])
         .write.mode(mode).option("maxRecordsPerFile", max_records_per_file).parquet(f"{base}/{name}"))


# Bucket keys: every table is bucketed on the key it is joined or grouped by
# most, so orders, items, payments and logs meet on ``order_id`` without a
# shuffle when they share a bucket count.
BUCKET_KEYS = {
    "orders": "order_id", "order_items": "order_id", "payments": "order_id", "order_logs": "order_id",
    "status_updates": "order_id", "users": "id", "addresses": "user_id", "services": "id", "menu": "id",
    "orders_by_user": "user_id",
}


def write_bucketed_tables(tables: Tables, database: str, buckets: int, mode: str = "errorifexists") -> None:
    """Save the bundle as catalog tables bucketed (and sorted) by their key.

    Joins and aggregations on ``order_id`` between orders, items, payments
    and logs then read co-partitioned buckets instead of shuffling either
    side (``spark.sql.sources.bucketing.enabled``).  A second copy of orders,
    ``orders_by_user``, is bucketed by ``user_id``: per-customer aggregates
    need no shuffle and a customer page's ``user_id IN (...)`` reads only the
    buckets holding those users.  Rows are dealt by bucket before the write, so
    a bucket is one file.  Choose ``buckets`` so a bucket of the largest table
    fits a task comfortably (e.g. 100-200 MB); a hot customer is one bucket.
    """
    spark = tables.orders.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    if tables.orders_by_user is None:
        tables = tables.with_tables(orders_by_user=tables.orders)
    for name in tables.names():
        key = BUCKET_KEYS[name]
        (getattr(tables, name).repartition(buckets, key).write.mode(mode).format("parquet")
         .bucketBy(buckets, key).sortBy(key).saveAsTable(f"{database}.{name}"))


def read_catalog_tables(spark: SparkSession, database: str) -> Tables:
    """The bundle from catalog tables (e.g. those written by
    :func:`write_bucketed_tables`)."""
    def table(name: str, required: bool = True) -> DataFrame | None:
        if not spark.catalog.tableExists(f"{database}.{name}"):
            if required:
                raise ValueError(f"missing table {database}.{name}")
            return None
        return spark.table(f"{database}.{name}")

    return Tables(
        orders=table("orders"), order_items=table("order_items"), users=table("users"),
        addresses=table("addresses"), payments=table("payments"), services=table("services"),
        menu=table("menu"), order_logs=table("order_logs", False), status_updates=table("status_updates", False),
        orders_by_user=table("orders_by_user", False),
    )
