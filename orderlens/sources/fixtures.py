"""Shop tables derived from the driver's TPC-H-like parquet files.

The reference ships no data, so the shop's tables are derived from the test
tables by SQL.  The SAME text runs in Spark (``spark.sql`` with DataFrame
arguments) and, as ``WITH`` clauses, in the DuckDB oracle, so both engines see
identical rows.  ``{name}`` placeholders are source tables or earlier derived
tables.
"""

from __future__ import annotations

import copy
import re
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from orderlens.plans.lineage import file_bytes, sweep
from orderlens.sources.tables import Tables

SOURCE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Derived table -> SQL.  Order matters: later entries may read earlier ones.
DERIVED_SQL: dict[str, str] = {
    "users": """
SELECT c_custkey AS id, c_name AS full_name,
  concat('9', lpad(CAST(c_custkey AS STRING), 9, '0')) AS phone,
  concat(lower(replace(c_name, '#', '.')), '@example.com') AS email,
  n_name AS city, r_name AS state, (c_custkey % 17 <> 0) AS is_active,
  DATE '2001-07-31' - CAST(c_custkey % 2403 AS INT) AS created_at
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
  JOIN {region} ON n_regionkey = r_regionkey""",
    "shop_orders": """
SELECT o_orderkey AS order_id,
  CASE WHEN o_orderkey % 211 = 0 THEN NULL WHEN o_orderkey % 223 = 0 THEN 0 ELSE o_custkey END AS user_id,
  u.full_name AS user_name, u.phone AS user_phone, u.email AS user_email,
  CASE WHEN o_orderkey % 233 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS total_amount,
  CASE WHEN o_orderkey % 3 = 0 THEN 'COD' ELSE 'Online' END AS payment_mode,
  u.city AS delivery_location,
  CASE WHEN o_orderkey % 227 = 0 THEN NULL ELSE CASE o_orderkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed'
    WHEN 2 THEN 'processing' WHEN 3 THEN 'shipped' WHEN 4 THEN 'delivered' ELSE 'cancelled' END END AS status,
  CASE WHEN o_orderkey % 229 = 0 THEN NULL
    ELSE o_orderdate + ((o_orderkey * 7919) % 86400) * INTERVAL '1' SECOND END AS order_date,
  o_orderdate + ((o_orderkey * 7919) % 86400 + 3600) * INTERVAL '1' SECOND AS delivery_date
FROM {orders} JOIN {users} u ON o_custkey = u.id""",
    "order_items": """
SELECT l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id,
  CASE WHEN p_size % 10 = 5 THEN 'combo' WHEN p_size % 2 = 0 THEN 'menu' ELSE 'service' END AS item_type,
  l_partkey AS item_id, p_name AS item_name, CAST(l_quantity AS BIGINT) AS quantity,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS total,
  CAST(p_retailprice AS DECIMAL(18,2)) AS price
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "menu": """
SELECT p_partkey AS id, p_name AS name,
  concat(p_type, ' ', p_name, ' by ', p_brand, ' with a rather long description') AS description,
  p_type AS category, CAST(p_retailprice AS DECIMAL(18,2)) AS price,
  CASE WHEN p_partkey % 4 = 0 THEN CAST(25.00 AS DECIMAL(18,2)) ELSE CAST(0.00 AS DECIMAL(18,2)) END AS discount,
  CASE WHEN p_partkey % 11 = 0 THEN 'inactive' ELSE 'active' END AS status
FROM {part} WHERE p_size % 2 = 0""",
    "services": """
SELECT p_partkey AS id, p_name AS name,
  concat(p_type, ' ', p_name, ' by ', p_brand, ' with a rather long description') AS description,
  p_type AS category, CAST(p_retailprice AS DECIMAL(18,2)) AS price,
  CASE WHEN p_partkey % 4 = 0 THEN CAST(25.00 AS DECIMAL(18,2)) ELSE CAST(0.00 AS DECIMAL(18,2)) END AS discount,
  CASE WHEN p_partkey % 11 = 0 THEN 'inactive' ELSE 'active' END AS status
FROM {part} WHERE p_size % 2 = 1 AND p_size % 10 <> 5""",
    # Two addresses per customer (k = 0 is the default); users with id % 7 = 0
    # have none.  Written as a UNION ALL of the two copies.
    "addresses": """
SELECT c_custkey * 2 + 0 AS id, c_custkey AS user_id, true AS is_default, n_name AS city, r_name AS state
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
WHERE c_custkey % 7 <> 0
UNION ALL
SELECT c_custkey * 2 + 1 AS id, c_custkey AS user_id, false AS is_default, n_name AS city, r_name AS state
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
WHERE c_custkey % 7 <> 0""",
    "payments": """
SELECT o_orderkey AS payment_id, o_orderkey AS order_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
  CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' ELSE 'completed' END AS payment_status,
  concat('txn_', lpad(CAST(o_orderkey AS STRING), 12, '0')) AS transaction_id,
  concat('sig_', lpad(CAST(o_orderkey AS STRING), 40, '0')) AS razorpay_signature
FROM {orders} WHERE o_orderkey % 5 <> 0""",
    # Stored log entries, beside those that status updates bring.
    "order_logs": """
SELECT event_id + 100000000 AS log_id, event_id % 1499 AS order_id, user_id AS admin_id, 'note' AS action,
  event_type AS details, CAST(NULL AS STRING) AS old_status,
  CASE WHEN event_id % 2 = 0 THEN 'pending' END AS new_status, ts AS created_at
FROM {events} WHERE event_id % 3 = 0""",
    "status_updates": """
SELECT event_id AS update_id,
  CASE WHEN event_id % 50 = 0 THEN -event_id - 1 ELSE event_id % 997 END AS order_id,
  CASE event_type WHEN 'view' THEN 'confirmed' WHEN 'click' THEN 'processing' WHEN 'signup' THEN 'shipped'
    WHEN 'purchase' THEN 'delivered' ELSE 'cancelled' END AS new_status,
  user_id AS admin_id, CAST(NULL AS STRING) AS notes, ts AS created_at
FROM {events}""",
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def _deps(name: str) -> list[str]:
    return _PLACEHOLDER.findall(DERIVED_SQL[name])


def read_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    base = sf_dir.rstrip("/")
    return {name: spark.read.parquet(f"{base}/{name}.parquet") for name in SOURCE_TABLES}


_DERIVED_CACHE: dict[tuple[str, str], dict[str, DataFrame]] = {}


def derive(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All derived tables as lazy DataFrames, keyed by derived name.

    Analysing the eight derivations costs over a second of driver time, so
    the (lazy, unexecuted) DataFrames are kept per session and folder and
    reused by every query; nothing is cached in executors.
    """
    key = (f"{spark.sparkContext.applicationId}:{id(spark)}", sf_dir.rstrip("/"))
    if key not in _DERIVED_CACHE:
        _DERIVED_CACHE[key] = _derive(spark, sf_dir)
    return _DERIVED_CACHE[key]


def _derive(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    env: dict[str, DataFrame] = read_sources(spark, sf_dir)
    out: dict[str, DataFrame] = {}
    for name, text in DERIVED_SQL.items():
        args = {dep: env[dep] for dep in set(_deps(name))}
        df = spark.sql(text, **args)
        env[name] = df
        out[name] = df
    return out


# Spark conf switch: write the derived tables once per session and read them
# back (default), or derive them inside every query ("false").
MATERIALIZE_CONF = "orderlens.fixtures.materialize"
_TABLES_CACHE: dict[tuple[str, str], Tables] = {}


def derived_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The derived shop tables as lazy DataFrames over the source files."""
    d = derive(spark, sf_dir)
    return Tables(
        orders=d["shop_orders"], order_items=d["order_items"], users=d["users"],
        addresses=d["addresses"], payments=d["payments"], services=d["services"],
        menu=d["menu"], order_logs=d["order_logs"], status_updates=d["status_updates"],
    )


def shop_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The shop tables for ``sf_dir``.

    By default each table is derived and written as parquet (range-partitioned
    by key, so scans run in parallel) under the session's
    ``spark.checkpoint.dir`` when a query first asks for it, once per session
    and folder; every query then reads those files, as it would read the shop's
    stored tables.  With ``orderlens.fixtures.materialize=false`` every query
    derives them from the source files instead.
    """
    if spark.conf.get(MATERIALIZE_CONF, "true").lower() != "true":
        return derived_tables(spark, sf_dir)
    key = (f"{spark.sparkContext.applicationId}:{id(spark)}", sf_dir.rstrip("/"))
    if key not in _TABLES_CACHE:
        _TABLES_CACHE[key] = StoredTables(spark, derived_tables(spark, sf_dir))
    return _TABLES_CACHE[key]


def tables_read_once(spark: SparkSession, sf_dir: str) -> Tables:
    """The shop tables for a query that reads each of them once: writing one
    first would cost more than deriving it, with only the columns and rows that
    are needed, where it is read.  What is stored by then is read."""
    tables = shop_tables(spark, sf_dir)
    return tables.unwritten() if isinstance(tables, StoredTables) else tables


#: Bytes of source files for a partition of a stored table: its rows take some
#: twenty times that in memory, which a task sorts without spilling.
PARTITION_BYTES = 16 << 20
#: Bytes of source files from which the shuffle files of a table go as soon as it is written.
SWEEP_BYTES = 64 << 20


class StoredTables(Tables):
    """The derived tables, each written when it is first asked for: a query
    waits for the tables that it reads, not for all."""

    __eq__, __hash__, __repr__ = object.__eq__, object.__hash__, object.__repr__  # those of fields would write every table

    def __init__(self, spark: SparkSession, derived: Tables):
        from orderlens.session import ensure_checkpoint_dir

        self._derived, self._given, self._stored = derived, {}, {}
        self._root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/shop-tables-{uuid.uuid4().hex[:12]}"

    def __getattribute__(self, name: str):
        if name not in Tables.__dataclass_fields__:
            return object.__getattribute__(self, name)
        if name in self._given:
            return self._given[name]
        if name not in self._stored:
            df = getattr(self._derived, name)
            self._stored[name] = None if df is None else self._write(name, df)
        return self._stored[name]

    def names(self) -> list[str]:
        return self._derived.with_tables(**self._given).names()

    def with_tables(self, **changes: DataFrame) -> Tables:
        out = copy.copy(self)  # what either of them writes is there for both
        out._given = {**self._given, **changes}
        return out

    def unwritten(self) -> Tables:
        """The same tables, those that are not stored yet as they are derived."""
        return self._derived.with_tables(**{**self._stored, **self._given})

    def _write(self, name: str, df: DataFrame) -> DataFrame:
        from orderlens.sources.tables import BUCKET_KEYS

        spark, key, path = df.sparkSession, BUCKET_KEYS[name], f"{self._root}/{name}"
        # one file per core, enough for parallel scans of small tables; more as the sources
        # grow, so that what a task sorts stays as large as it is
        size = file_bytes(df)
        n = max(1, spark.sparkContext.defaultParallelism, -(-size // PARTITION_BYTES))
        df.repartitionByRange(n, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path, compression="zstd")
        if size >= SWEEP_BYTES:
            sweep(spark)
        return spark.read.parquet(path)


@lru_cache(maxsize=None)
def _closure(names: tuple[str, ...]) -> tuple[str, ...]:
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in SOURCE_TABLES or n in ordered:
            return
        for dep in _deps(n):
            visit(dep)
        ordered.append(n)

    for n in names:
        visit(n)
    return tuple(ordered)


def oracle_prelude(*names: str, extra: tuple[str, ...] = ()) -> str:
    """``WITH`` clauses defining the named derived tables (and what they read)
    for DuckDB, where the source tables are pre-registered views.  ``extra``
    CTEs (``name AS (...)``) follow and may read the derived ones."""
    parts = []
    for n in _closure(tuple(names)):
        body = _PLACEHOLDER.sub(lambda m: m.group(1), DERIVED_SQL[n]).strip()
        parts.append(f"{n} AS (\n{body}\n)")
    parts.extend(extra)
    return "WITH " + ",\n".join(parts) + "\n"


def stream_source(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int = 1) -> DataFrame:
    """A source table read as a file stream (schema taken from the file)."""
    base = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{base}/{name}.parquet").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .option("maxFilesPerTrigger", max_files_per_trigger).parquet(base))


def derive_streaming(spark: SparkSession, sf_dir: str, target: str, streamed: str) -> DataFrame:
    """Derived table ``target`` with the source ``streamed`` read as a stream
    and everything else static (stream-static joins)."""
    env: dict[str, DataFrame] = read_sources(spark, sf_dir)
    env[streamed] = stream_source(spark, sf_dir, streamed)
    for name in _closure((target,)):
        env[name] = spark.sql(DERIVED_SQL[name], **{d: env[d] for d in set(_deps(name))})
    return env[target]
