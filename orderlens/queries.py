"""The registered queries: each one is a Spark builder plus the DuckDB SQL that
must give the same rows on the same derived tables.

Builders take ``(spark, sf_dir)``, derive the shop tables from the driver's
parquet (``sources.fixtures``) and run one library operator over the WHOLE
tables.  Money leaves as ``double`` in both engines so values hash alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions.period import ntz_to_instant, period_bounds, sql_ts
from orderlens.operators import stats
from orderlens.sources.fixtures import oracle_prelude, shop_tables, tables_read_once

AS_OF = datetime(2001, 7, 31, 12, 0, 0)

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}
# The library call behind each registered query, on any Tables bundle.
OPERATORS: dict[str, Callable] = {}


def for_check(df: DataFrame) -> DataFrame:
    """Decimals leave as double and dates as midnight timestamps: DuckDB's
    pandas export turns DECIMAL into float64 and DATE into datetime64, so the
    oracle SQL casts the same way and both sides hash alike."""
    def conv(f: T.StructField):
        if isinstance(f.dataType, T.DecimalType):
            return F.col(f.name).cast("double").alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return F.col(f.name).cast("timestamp_ntz").alias(f.name)
        return F.col(f.name)
    return df.select(*[conv(f) for f in df.schema.fields])


def register(name: str, sql: str | None = None, tables: Callable = shop_tables):
    def deco(fn: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: for_check(fn(tables(spark, sf_dir)))
        OPERATORS[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def bounds_sql(period: str, col: str = "order_date") -> str:
    lo, hi = period_bounds(period, AS_OF)
    return f"{col} BETWEEN {sql_ts(lo)} AND {sql_ts(hi)}"


# --- V6: period statistics ----------------------------------------------------

def _totals_sql(period: str) -> str:
    return oracle_prelude("shop_orders") + f"""
SELECT COUNT(*) AS total_orders,
  COALESCE(CAST(SUM(total_amount) AS DOUBLE), 0) AS total_revenue,
  COALESCE(CAST(SUM(total_amount) AS DOUBLE) / CAST(COUNT(total_amount) AS DOUBLE), 0) AS avg_order_value
FROM shop_orders WHERE {bounds_sql(period)}"""


for _p in ("today", "yesterday", "week", "month", "last_month", "all"):
    register(f"totals_{_p}", _totals_sql(_p))(lambda t, p=_p: stats.totals(t, p, AS_OF))


def _top_items_sql(period: str, limit: int = 10, extra: str = "") -> str:
    return oracle_prelude("shop_orders", "order_items") + f"""
SELECT oi.item_name, oi.item_type,
  CAST(COALESCE(SUM(oi.quantity), 0) AS BIGINT) AS total_quantity,
  COALESCE(CAST(SUM(oi.total) AS DOUBLE), 0) AS total_revenue{extra}
FROM order_items oi JOIN shop_orders o ON oi.order_id = o.order_id
WHERE {bounds_sql(period, 'o.order_date')}
GROUP BY oi.item_name, oi.item_type
ORDER BY total_quantity DESC, oi.item_name ASC NULLS LAST, oi.item_type ASC NULLS LAST
LIMIT {limit}"""


for _p in ("today", "week", "month", "all"):
    register(f"top_items_{_p}", _top_items_sql(_p))(lambda t, p=_p: stats.top_items(t, p, AS_OF))


def _status_sql(period: str) -> str:
    return oracle_prelude("shop_orders") + f"""
SELECT status, COUNT(*) AS count FROM shop_orders WHERE {bounds_sql(period)} GROUP BY status"""


for _p in ("month", "all"):
    register(f"status_distribution_{_p}", _status_sql(_p))(
        lambda t, p=_p: stats.status_distribution(t, p, AS_OF))


def _timeline_sql(period: str, unit: str) -> str:
    expr = {"hour": "date_trunc('hour', order_date)", "day": "CAST(CAST(order_date AS DATE) AS TIMESTAMP)",
            "month": "date_trunc('month', order_date)"}[unit]
    return oracle_prelude("shop_orders") + f"""
SELECT {expr} AS period, COUNT(*) AS order_count,
  COALESCE(CAST(SUM(total_amount) AS DOUBLE), 0) AS total_revenue
FROM shop_orders WHERE {bounds_sql(period)} GROUP BY 1 ORDER BY 1 NULLS FIRST"""


for _name, _p, _u in (("today_hour", "today", "hour"), ("week_day", "week", "day"),
                      ("month_day", "month", "day"), ("all_month", "all", "month"),
                      ("last_month_day", "last_month", "day")):
    register(f"timeline_{_name}", _timeline_sql(_p, _u))(
        lambda t, p=_p, u=_u: stats.timeline(t, p, AS_OF, u))


# --- V1, V2: order lists ------------------------------------------------------

from orderlens.operators import customers, orders  # noqa: E402
from orderlens.plans.lineage import materialize  # noqa: E402
from orderlens.plans.paging import page_count  # noqa: E402
from orderlens.plans.selection import deep_page  # noqa: E402

_AS_OF_DAY = "DATE '2001-07-31'"


def _orders_list_sql(cols: list[str], where: str, limit: int, offset: int = 0) -> str:
    sel = ", ".join("CAST(o.total_amount AS DOUBLE) AS total_amount" if c == "total_amount" else f"o.{c}"
                    for c in cols)
    grp = ", ".join(f"o.{c}" for c in cols)
    off = f" OFFSET {offset}" if offset else ""
    return oracle_prelude("shop_orders", "order_items") + f"""
SELECT {sel}, COUNT(oi.order_item_id) AS item_count
FROM shop_orders o LEFT JOIN order_items oi ON o.order_id = oi.order_id
WHERE {where}
GROUP BY {grp}
ORDER BY o.order_date DESC NULLS FIRST, o.order_id DESC
LIMIT {limit}{off}"""


register("todays_orders_live", _orders_list_sql(
    orders.TODAY_COLUMNS_LIVE, f"CAST(o.order_date AS DATE) = {_AS_OF_DAY}", 20))(
    lambda t: orders.todays_orders(t, AS_OF, "live"))
register("todays_orders_from", _orders_list_sql(
    orders.TODAY_COLUMNS, f"CAST(o.order_date AS DATE) >= {_AS_OF_DAY}", 50))(
    lambda t: orders.todays_orders(t, AS_OF, "from"))
register("todays_orders_until_now", _orders_list_sql(
    orders.TODAY_COLUMNS, bounds_sql("today", "o.order_date"), 50))(
    lambda t: orders.todays_orders(t, AS_OF, "until_now"))


def _search_sql(term: str, cols: list[str], alias: str = "o") -> str:
    pat = "'%" + term.replace("'", "''") + "%'"
    return "(" + " OR ".join(f"{c} ILIKE {pat}" for c in cols) + ")"


_ORDER_SEARCH_COLS = ["o.user_name", "o.user_phone", "o.user_email", "CAST(o.order_id AS VARCHAR)"]
_USER_SEARCH_COLS = ["u.full_name", "u.phone", "u.email"]

register("orders_page", _orders_list_sql(orders.LIST_COLUMNS, "TRUE", 20))(
    lambda t: orders.list_orders(t, page=1))
register("orders_page_3", _orders_list_sql(orders.LIST_COLUMNS, "TRUE", 20, 40))(
    lambda t: orders.list_orders(t, page=3))
register("orders_page_live", _orders_list_sql(orders.LIST_COLUMNS_LIVE, "TRUE", 20))(
    lambda t: orders.list_orders(t, page=1, live_columns=True))
register("orders_page_status", _orders_list_sql(orders.LIST_COLUMNS, "o.status = 'pending'", 20, 20))(
    lambda t: orders.list_orders(t, page=2, status="pending"))
register("orders_search", _orders_list_sql(
    orders.LIST_COLUMNS, _search_sql("#0000011", _ORDER_SEARCH_COLS), 20))(
    lambda t: orders.list_orders(t, search="#0000011"))
register("orders_search_wildcard", _orders_list_sql(
    orders.LIST_COLUMNS, "o.status = 'delivered' AND " + _search_sql("9_0%12", _ORDER_SEARCH_COLS), 20))(
    lambda t: orders.list_orders(t, status="delivered", search="9_0%12"))
register("orders_count_filtered", oracle_prelude("shop_orders") + f"""
SELECT COUNT(*) AS total FROM shop_orders o
WHERE o.status = 'shipped' AND {_search_sql('0001', _ORDER_SEARCH_COLS)}""")(
    lambda t: orders.count_orders(t, status="shipped", search="0001"))
register("orders_count_distinct", oracle_prelude("shop_orders") + f"""
SELECT COUNT(DISTINCT o.order_id) AS total FROM shop_orders o
WHERE {_search_sql('CUSTOMER#00000', _ORDER_SEARCH_COLS)}""")(
    lambda t: orders.count_orders_distinct(t, search="CUSTOMER#00000"))
register("orders_page_count", oracle_prelude("shop_orders") + """
SELECT total, CAST(GREATEST(CEIL(total / 20.0), 1) AS BIGINT) AS total_pages
FROM (SELECT COUNT(*) AS total FROM shop_orders o WHERE o.status = 'pending')""")(
    lambda t: page_count(orders.count_orders(t, status="pending")))
register("order_item_counts", oracle_prelude("shop_orders", "order_items") + """
SELECT o.order_id, COUNT(oi.order_item_id) AS item_count
FROM shop_orders o LEFT JOIN order_items oi ON o.order_id = oi.order_id GROUP BY o.order_id""")(
    orders.item_counts)


# --- V4, V5: customers ---------------------------------------------------------

_USER_COLS = ["id", "full_name", "phone", "email", "city", "state", "is_active", "created_at"]


def _customers_sql(where: str, limit: int | None, offset: int = 0) -> str:
    sel = ", ".join("CAST(u.created_at AS TIMESTAMP) AS created_at" if c == "created_at" else f"u.{c}"
                    for c in _USER_COLS)
    grp = ", ".join(f"u.{c}" for c in _USER_COLS)
    tail = ""
    if limit is not None:
        tail = f"ORDER BY u.created_at DESC NULLS FIRST, u.id DESC LIMIT {limit}" + (f" OFFSET {offset}" if offset else "")
    return oracle_prelude("users", "shop_orders") + f"""
SELECT {sel}, COUNT(o.order_id) AS total_orders,
  COALESCE(CAST(SUM(o.total_amount) AS DOUBLE), 0) AS total_spent, MAX(o.order_date) AS last_order_date
FROM users u LEFT JOIN shop_orders o ON u.id = o.user_id
WHERE {where}
GROUP BY {grp}
{tail}"""


register("customers_page", _customers_sql("TRUE", 20))(lambda t: customers.list_customers(t, page=1))
register("customers_page_2", _customers_sql("TRUE", 20, 20))(lambda t: customers.list_customers(t, page=2))
register("customers_search", _customers_sql(_search_sql("customer#00000", _USER_SEARCH_COLS), 20))(
    lambda t: customers.list_customers(t, search="customer#00000"))
register("customers_count_filtered", oracle_prelude("users") + f"""
SELECT COUNT(*) AS total FROM users u WHERE {_search_sql('.0000012', _USER_SEARCH_COLS)}""")(
    lambda t: customers.count_customers(t, search=".0000012"))
register("customer_metrics", _customers_sql("TRUE", None))(customers.customer_metrics)
register("customer_dossier_stats", oracle_prelude("users", "shop_orders") + """
SELECT u.id AS user_id, COUNT(o.order_id) AS total_orders,
  COALESCE(CAST(SUM(o.total_amount) AS DOUBLE), 0) AS total_spent,
  COALESCE(CAST(SUM(o.total_amount) AS DOUBLE) / CAST(COUNT(o.total_amount) AS DOUBLE), 0) AS avg_order_value
FROM users u LEFT JOIN shop_orders o ON u.id = o.user_id GROUP BY u.id""")(customers.customer_stats)
register("customer_recent_orders", oracle_prelude("shop_orders") + """
SELECT * FROM (
  SELECT o.*, row_number() OVER (PARTITION BY user_id ORDER BY order_date DESC NULLS FIRST, order_id DESC)
    AS recent_rank
  FROM shop_orders o WHERE user_id IS NOT NULL)
WHERE recent_rank <= 10""")(
    lambda t: customers.recent_orders(t).withColumn("recent_rank", F.col("recent_rank").cast("bigint")))
register("customer_addresses", oracle_prelude("addresses") + """
SELECT a.*, CASE WHEN a.is_default IS NULL THEN 0 WHEN a.is_default THEN 1 ELSE 2 END AS default_rank
FROM addresses a""")(customers.addresses_ranked)


# --- V3, V12: dossiers and payments --------------------------------------------

from orderlens.operators import dossiers, updates  # noqa: E402
from orderlens.plans.positions import with_positions  # noqa: E402

_RUPEE = "'₹' || format('{:,.2f}', COALESCE(CAST(%s AS DOUBLE), 0))"  # NULL reads as zero
_DT_FMT = "coalesce(strftime(%s, '%%d %%b %%Y, %%I:%%M %%p'), '')"

register("order_items_named", oracle_prelude("order_items", "services", "menu") + f"""
SELECT oi.order_item_id, oi.order_id, oi.item_type, oi.item_id, oi.item_name, oi.quantity,
  CAST(oi.total AS DOUBLE) AS total, CAST(oi.price AS DOUBLE) AS price,
  CASE WHEN oi.item_type = 'service' THEN s.name WHEN oi.item_type = 'menu' THEN m.name
    ELSE 'Unknown Item' END AS full_name,
  {_RUPEE % 'oi.price'} AS price_formatted, {_RUPEE % 'oi.total'} AS total_formatted
FROM order_items oi
LEFT JOIN services s ON oi.item_type = 'service' AND oi.item_id = s.id
LEFT JOIN menu m ON oi.item_type = 'menu' AND oi.item_id = m.id""")(lambda t: dossiers.named_items(t))

_FIRST_PAYMENT = """first_payment AS (
  SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY order_id
    ORDER BY payment_id, amount, payment_status, transaction_id, razorpay_signature) AS rn FROM payments p)
  WHERE rn = 1)"""
_DEFAULT_ADDRESS = """default_address AS (
  SELECT * FROM (SELECT a.*, row_number() OVER (PARTITION BY user_id ORDER BY id) AS rn
    FROM addresses a WHERE a.is_default) WHERE rn = 1)"""

register("order_dossier_flat", oracle_prelude("shop_orders", "order_items", "payments", "users", "addresses",
                                             extra=(_FIRST_PAYMENT, _DEFAULT_ADDRESS)) + f"""
SELECT o.order_id, o.user_id, o.user_name, o.user_phone, o.user_email, CAST(o.total_amount AS DOUBLE) AS total_amount,
  o.payment_mode, o.delivery_location, o.status, o.order_date, o.delivery_date,
  (SELECT COUNT(oi.order_item_id) FROM order_items oi WHERE oi.order_id = o.order_id) AS item_count,
  {_DT_FMT % 'o.order_date'} AS order_date_formatted, {_RUPEE % 'o.total_amount'} AS total_amount_formatted,
  p.payment_id, p.payment_status, CAST(p.amount AS DOUBLE) AS payment_amount,
  u.full_name AS customer_name, u.email AS customer_email,
  CASE WHEN u.id IS NOT NULL THEN a.id END AS default_address_id,
  CASE WHEN u.id IS NOT NULL THEN a.city END AS default_address_city
FROM shop_orders o
LEFT JOIN first_payment p ON p.order_id = o.order_id
LEFT JOIN users u ON o.user_id IS NOT NULL AND o.user_id <> 0 AND u.id = o.user_id
LEFT JOIN default_address a ON a.user_id = u.id""", tables_read_once)(lambda t: dossiers.order_dossier_flat(t))

register("order_payment", oracle_prelude("payments", extra=(_FIRST_PAYMENT,)) + """
SELECT order_id, payment_id, CAST(amount AS DOUBLE) AS amount, payment_status, transaction_id, razorpay_signature
FROM first_payment""")(lambda t: dossiers.first_payments(t).select("order_id", "payment.*"))

register("order_customer_default_address", oracle_prelude("addresses", extra=(_DEFAULT_ADDRESS,)) + """
SELECT user_id, id, is_default, city, state FROM default_address""")(
    lambda t: dossiers.default_addresses(t).select("user_id", "address.*"))

register("payment_details", oracle_prelude("shop_orders", "payments", extra=(_FIRST_PAYMENT,)) + f"""
SELECT p.order_id, p.payment_id, o.user_name, o.payment_mode, p.payment_status,
  CAST(p.amount AS DOUBLE) AS amount, {_RUPEE % 'p.amount'} AS amount_formatted,
  CASE lower(p.payment_status) WHEN 'pending' THEN 'warning' WHEN 'completed' THEN 'success'
    WHEN 'failed' THEN 'danger' WHEN 'refunded' THEN 'secondary' WHEN 'processing' THEN 'info'
    ELSE 'secondary' END AS payment_badge,
  'N/A' AS payment_date_formatted, p.transaction_id,
  CAST(NULL AS VARCHAR) AS razorpay_order_id, CAST(NULL AS VARCHAR) AS razorpay_payment_id,
  CASE WHEN p.razorpay_signature IS NOT NULL THEN substr(p.razorpay_signature, 1, 30) || '...' END
    AS signature_masked
FROM first_payment p LEFT JOIN shop_orders o ON o.order_id = p.order_id""")(
    lambda t: dossiers.payment_details(t))

_NAMED_ITEMS = """named_items AS (
  SELECT oi.*, CASE WHEN oi.item_type = 'service' THEN s.name WHEN oi.item_type = 'menu' THEN m.name ELSE 'Unknown Item' END AS full_name
  FROM order_items oi LEFT JOIN services s ON oi.item_type = 'service' AND oi.item_id = s.id
  LEFT JOIN menu m ON oi.item_type = 'menu' AND oi.item_id = m.id)"""
_RANKED_ADDRESSES = """ranked_addresses AS (
  SELECT user_id, id, city, row_number() OVER (PARTITION BY user_id
    ORDER BY CASE WHEN is_default IS NULL THEN 0 WHEN is_default THEN 1 ELSE 2 END, id) - 1 AS position FROM addresses)"""
_JSON_TIME = "strftime(%s, '%%Y-%%m-%%dT%%H:%%M:%%S.%%f')"


def _order_json_sql(where: str = "TRUE", size: int = 3) -> str:
    """Every element of the order documents: pages of ``size``, a row of NULLs for an empty list."""
    return oracle_prelude("shop_orders", "order_items", "services", "menu", "users", "addresses", "order_logs",
                          extra=(_NAMED_ITEMS, _RANKED_ADDRESSES)) + f""",
elements AS (
  SELECT order_id, 'items' AS section, row_number() OVER (PARTITION BY order_id ORDER BY order_item_id, item_id, total) - 1 AS position,
    order_item_id AS id, full_name AS label, CAST(total AS DOUBLE) AS amount, CAST(NULL AS VARCHAR) AS at_time FROM named_items
  UNION ALL
  SELECT o.order_id, 'addresses', a.position, a.id, a.city, NULL, NULL FROM shop_orders o JOIN users u ON u.id = o.user_id
    JOIN ranked_addresses a ON a.user_id = o.user_id WHERE o.user_id <> 0
  UNION ALL
  SELECT order_id, 'logs', row_number() OVER (PARTITION BY order_id ORDER BY created_at DESC NULLS FIRST, log_id DESC) - 1,
    log_id, new_status, NULL, {_JSON_TIME % 'created_at'} FROM order_logs
  UNION ALL
  SELECT order_id, 'order', 0, order_id, status, CAST(total_amount AS DOUBLE), {_JSON_TIME % 'order_date'} FROM shop_orders),
lists AS (SELECT o.order_id, s.section FROM shop_orders o, (VALUES ('items'), ('addresses'), ('logs'), ('order')) s(section)),
counted AS (SELECT *, COUNT(*) OVER (PARTITION BY order_id, section) AS n FROM elements)
SELECT l.order_id, l.section, CAST(COALESCE(position // {size}, 0) AS BIGINT) AS part,
  CAST(CASE WHEN l.section = 'order' THEN 1 ELSE GREATEST(CEIL(COALESCE(n, 0) / {size}), 1) END AS BIGINT) AS parts,
  position, CAST(id AS VARCHAR) AS id, label, amount, at_time
FROM lists l LEFT JOIN counted e ON e.order_id = l.order_id AND e.section = l.section WHERE {where}"""


def _customer_json_sql(where: str = "TRUE") -> str:
    return oracle_prelude("shop_orders", "users", "addresses", extra=(_RANKED_ADDRESSES,)) + f""",
elements AS (
  SELECT u.id AS user_id, 'user' AS section, 0 AS position, u.id AS id, u.full_name AS label,
    COALESCE(CAST(SUM(o.total_amount) AS DOUBLE), 0) AS amount, CAST(NULL AS VARCHAR) AS at_time
  FROM users u LEFT JOIN shop_orders o ON o.user_id = u.id GROUP BY u.id, u.full_name
  UNION ALL
  SELECT user_id, 'addresses', position, id, city, NULL, NULL FROM ranked_addresses
  UNION ALL
  SELECT user_id, 'orders', rank - 1, order_id, status, CAST(total_amount AS DOUBLE), {_JSON_TIME % 'order_date'} FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY order_date DESC NULLS FIRST, order_id DESC) AS rank
    FROM shop_orders) WHERE rank <= 10),
lists AS (SELECT u.id AS user_id, s.section FROM users u, (VALUES ('user'), ('addresses'), ('orders')) s(section)),
counted AS (SELECT *, COUNT(*) OVER (PARTITION BY user_id, section) AS n FROM elements)
SELECT l.user_id, l.section, CAST(CASE WHEN l.section = 'addresses' THEN COALESCE(position, 0) ELSE 0 END AS BIGINT) AS part,
  CAST(CASE WHEN l.section = 'addresses' THEN GREATEST(COALESCE(n, 0), 1) ELSE 1 END AS BIGINT) AS parts,
  position, CAST(id AS VARCHAR) AS id, label, amount, at_time
FROM lists l LEFT JOIN counted e ON e.user_id = l.user_id AND e.section = l.section WHERE {where}"""


_SOME_ORDERS = tuple(range(7, 4000, 101))          # a literal list of keys
_MANY_ORDERS = tuple(range(0, 18000, 9))           # above the bound of a literal list
_SOME_USERS = tuple(range(1, 140, 6))


def _in(col: str, ids: tuple[int, ...]) -> str:
    return f"{col} IN ({', '.join(map(str, ids))})"


# JSON documents, written and read back element by element
register("order_dossier_json", _order_json_sql())(
    lambda t: dossiers.document_elements(dossiers.order_documents(t, chunk_size=3), "order_id"))
register("order_dossier_json_ids", _order_json_sql(_in("l.order_id", _SOME_ORDERS), 2))(
    lambda t: dossiers.document_elements(dossiers.order_documents(t, iter(_SOME_ORDERS), chunk_size=2), "order_id"))
register("customer_dossier_json", _customer_json_sql())(
    lambda t: dossiers.document_elements(dossiers.customer_documents(t, chunk_size=1), "user_id"))
register("customer_dossier_json_ids", _customer_json_sql(_in("l.user_id", _SOME_USERS)))(
    lambda t: dossiers.document_elements(dossiers.customer_documents(t, list(_SOME_USERS), chunk_size=1), "user_id"))
for _n, _ids in (("some", _SOME_ORDERS), ("many", _MANY_ORDERS)):
    register(f"order_dossier_flat_ids_{_n}", f"SELECT * FROM ({ORACLE['order_dossier_flat']}) q WHERE {_in('order_id', _ids)}",
             tables_read_once)(
        lambda t, ids=_ids: dossiers.order_dossier_flat(t, ids))
    register(f"payment_details_ids_{_n}", f"SELECT * FROM ({ORACLE['payment_details']}) q WHERE {_in('order_id', _ids)}")(
        lambda t, ids=_ids: dossiers.payment_details(t, ids))
register("stored_order_logs_ranked", oracle_prelude("order_logs") + """
SELECT l.*, row_number() OVER (PARTITION BY order_id ORDER BY created_at DESC NULLS FIRST, log_id DESC) - 1 AS position FROM order_logs l""")(
    lambda t: with_positions(t.order_logs, "order_id", [F.desc_nulls_first("created_at"), F.desc("log_id")]))


# --- V10: catalogue ------------------------------------------------------------

from orderlens.functions.format import DEFAULT_IMAGE  # noqa: E402
from orderlens.operators import catalogue  # noqa: E402

_CATALOGUE_CTES = (
    """cat AS (SELECT 'service' AS item_type, s.* FROM services s
  UNION ALL SELECT 'menu' AS item_type, m.* FROM menu m)""",
    """sales AS (SELECT item_type, item_id AS id, COUNT(*) AS times_ordered, SUM(quantity) AS total_quantity
  FROM order_items GROUP BY item_type, item_id)""",
)


def _catalogue_sql(where: str) -> str:
    return oracle_prelude("services", "menu", "order_items", extra=_CATALOGUE_CTES) + f"""
SELECT c.item_type, c.id, c.name, c.category, c.status, '{DEFAULT_IMAGE}' AS photo_url,
  CASE WHEN length(c.description) > 50 THEN left(c.description, 50) || '...' ELSE c.description END
    AS description_short,
  CAST(c.price AS DOUBLE) AS price, CAST(c.discount AS DOUBLE) AS discount,
  CAST(c.price - c.discount AS DOUBLE) AS final_price,
  {_RUPEE % 'c.price'} AS price_formatted, {_RUPEE % 'c.discount'} AS discount_formatted,
  {_RUPEE % '(c.price - c.discount)'} AS final_price_formatted,
  (c.discount > 0) AS has_discount, COALESCE(s.times_ordered, 0) AS times_ordered,
  CAST(s.total_quantity AS BIGINT) AS total_quantity,
  CASE WHEN c.status = 'active' THEN 'success' ELSE 'danger' END AS status_badge
FROM cat c LEFT JOIN sales s ON s.item_type = c.item_type AND s.id = c.id
WHERE {where}"""


register("catalogue_sales", _catalogue_sql("TRUE"))(lambda t: catalogue.catalogue(t))
register("catalogue_search", _catalogue_sql("c.item_type = 'menu' AND c.name ILIKE '%rod%'"))(
    lambda t: catalogue.catalogue(t, item_type="menu", search="rod"))


# --- V11: status updates ---------------------------------------------------------

_UPDATE_CTES = (
    "valid AS (SELECT u.* FROM status_updates u WHERE EXISTS "
    "(SELECT 1 FROM shop_orders o WHERE o.order_id = u.order_id))",
    """seq AS (SELECT v.*, lag(new_status) OVER w AS prev_status, row_number() OVER w AS rn FROM valid v
  WINDOW w AS (PARTITION BY order_id ORDER BY created_at ASC NULLS FIRST, update_id ASC))""",
    """last_update AS (SELECT * FROM (SELECT v.*, row_number() OVER (PARTITION BY order_id
  ORDER BY created_at DESC NULLS LAST, update_id DESC) AS rn FROM valid v) WHERE rn = 1)""",
)

register("status_updates_log", oracle_prelude("shop_orders", "status_updates", extra=_UPDATE_CTES) + """
SELECT s.update_id AS log_id, s.order_id, s.admin_id, 'status_update' AS action, s.notes AS details,
  CASE WHEN s.rn = 1 THEN o.status ELSE s.prev_status END AS old_status, s.new_status, s.created_at
FROM seq s JOIN shop_orders o ON o.order_id = s.order_id""")(
    lambda t: updates.apply_status_updates(t.orders, t.status_updates).logs)

register("status_updates_snapshot", oracle_prelude("shop_orders", "status_updates", extra=_UPDATE_CTES) + """
SELECT o.order_id, o.user_id, o.user_name, o.user_phone, o.user_email, CAST(o.total_amount AS DOUBLE) AS total_amount,
  o.payment_mode, o.delivery_location,
  CASE WHEN l.order_id IS NOT NULL THEN l.new_status ELSE o.status END AS status, o.order_date, o.delivery_date
FROM shop_orders o LEFT JOIN last_update l ON l.order_id = o.order_id""")(
    lambda t: updates.apply_status_updates(t.orders, t.status_updates).snapshot)

register("status_updates_rejects", oracle_prelude("shop_orders", "status_updates") + """
SELECT u.*, 'Order not found' AS reason FROM status_updates u
WHERE NOT EXISTS (SELECT 1 FROM shop_orders o WHERE o.order_id = u.order_id)""")(
    lambda t: updates.apply_status_updates(t.orders, t.status_updates).rejects)


# --- V7, V8: dashboard and KPIs; A15, A16, W3 ------------------------------------

register("dashboard_kpis", oracle_prelude("shop_orders", "users") + f"""
SELECT
  (SELECT COUNT(*) FROM shop_orders WHERE CAST(order_date AS DATE) = {_AS_OF_DAY}) AS today_orders,
  (SELECT COALESCE(CAST(SUM(total_amount) AS DOUBLE), 0) FROM shop_orders
    WHERE CAST(order_date AS DATE) = {_AS_OF_DAY}) AS today_revenue,
  (SELECT COALESCE(CAST(SUM(total_amount) AS DOUBLE) / CAST(COUNT(total_amount) AS DOUBLE), 0) FROM shop_orders
    WHERE CAST(order_date AS DATE) = {_AS_OF_DAY}) AS today_avg_order_value,
  (SELECT COUNT(*) FROM shop_orders WHERE status = 'pending') AS pending_orders,
  (SELECT COUNT(*) FROM users WHERE CAST(created_at AS DATE) = {_AS_OF_DAY}) AS new_customers""")(
    lambda t: stats.dashboard_kpis(t, AS_OF))

register("dashboard_top5", _top_items_sql(
    "today", 5, extra=",\n  CASE WHEN length(oi.item_name) > 20 THEN left(oi.item_name, 20) || '...' "
    "ELSE oi.item_name END AS item_label"))(lambda t: stats.dashboard_top(t, AS_OF))

register("today_totals", oracle_prelude("shop_orders") + f"""
SELECT COUNT(*) AS total_orders, COALESCE(CAST(SUM(total_amount) AS DOUBLE), 0) AS total_revenue,
  COALESCE(CAST(SUM(total_amount) AS DOUBLE) / CAST(COUNT(total_amount) AS DOUBLE), 0) AS avg_order_value
FROM shop_orders WHERE CAST(order_date AS DATE) = {_AS_OF_DAY}""")(lambda t: stats.today_totals(t, AS_OF))

register("pending_orders", oracle_prelude("shop_orders") + """
SELECT COUNT(*) AS pending FROM shop_orders WHERE status = 'pending'""")(stats.pending_orders)

register("new_users_today", oracle_prelude("users") + f"""
SELECT COUNT(*) AS new_customers FROM users WHERE CAST(created_at AS DATE) = {_AS_OF_DAY}""")(
    lambda t: stats.new_users_on(t, AS_OF))

register("admin_kpis", oracle_prelude("shop_orders", "users") + f"""
SELECT (SELECT COUNT(*) FROM shop_orders) AS total_orders,
  (SELECT COALESCE(CAST(SUM(total_amount) AS DOUBLE), 0) FROM shop_orders) AS total_revenue_amount,
  (SELECT COUNT(*) FROM users) AS total_customers,
  (SELECT COUNT(*) FROM shop_orders WHERE status = 'pending') AS pending_orders,
  {_RUPEE % '(SELECT COALESCE(CAST(SUM(total_amount) AS DOUBLE), 0) FROM shop_orders)'} AS total_revenue""")(
    stats.admin_kpis)

register("top_items_avg_price", _top_items_sql(
    "month", 10,
    extra=",\n  CASE WHEN COALESCE(SUM(oi.quantity), 0) > 0 THEN COALESCE(CAST(SUM(oi.total) AS DOUBLE), 0)"
          " / CAST(COALESCE(SUM(oi.quantity), 0) AS DOUBLE) ELSE 0.0 END AS avg_price,\n"
          "  '₹' || format('{:,.2f}', CASE WHEN COALESCE(SUM(oi.quantity), 0) > 0 THEN"
          " COALESCE(CAST(SUM(oi.total) AS DOUBLE), 0) / CAST(COALESCE(SUM(oi.quantity), 0) AS DOUBLE)"
          " ELSE 0.0 END) AS avg_price_formatted"))(
    lambda t: stats.with_avg_price(stats.top_items(t, "month", AS_OF)))

register("best_seller", oracle_prelude("shop_orders", "order_items") + f"""
SELECT COALESCE((SELECT oi.item_name
  FROM order_items oi JOIN shop_orders o ON oi.order_id = o.order_id
  WHERE {bounds_sql('week', 'o.order_date')}
  GROUP BY oi.item_name, oi.item_type
  ORDER BY COALESCE(SUM(oi.quantity), 0) DESC, oi.item_name ASC NULLS LAST, oi.item_type ASC NULLS LAST
  LIMIT 1), 'N/A') AS best_seller""")(lambda t: stats.best_seller(t, "week", AS_OF))

register("status_share", oracle_prelude("shop_orders") + f"""
SELECT status, count, CAST(floor(CAST(count AS DOUBLE) / CAST(SUM(count) OVER () AS DOUBLE) * 100.0 + 0.5)
  AS BIGINT) AS percentage
FROM (SELECT status, COUNT(*) AS count FROM shop_orders WHERE {bounds_sql('all')} GROUP BY status)""")(
    lambda t: stats.status_share(stats.status_distribution(t, "all", AS_OF)))


# --- V9: chart series --------------------------------------------------------------

from orderlens.operators import charts  # noqa: E402


def _chart_timeline_sql(period: str, unit: str, label: str) -> str:
    expr = {"hour": "date_trunc('hour', order_date)", "day": "CAST(order_date AS DATE)",
            "month": "date_trunc('month', order_date)"}[unit]
    return oracle_prelude("shop_orders") + f"""
SELECT strftime(period, '{label}') AS label, order_count AS orders, revenue,
  CAST(row_number() OVER (ORDER BY period NULLS FIRST) AS BIGINT) AS position
FROM (SELECT {expr} AS period, COUNT(*) AS order_count,
  COALESCE(CAST(SUM(total_amount) AS DOUBLE), 0) AS revenue
  FROM shop_orders WHERE {bounds_sql(period)} GROUP BY 1 ORDER BY 1 NULLS FIRST LIMIT 20)"""


register("chart_timeline", _chart_timeline_sql("month", "day", "%Y-%m-%d"))(
    lambda t: charts.chart_timeline(stats.timeline(t, "month", AS_OF)))
register("chart_timeline_all", _chart_timeline_sql("all", "month", "%d %b %I:%M %p"))(
    lambda t: charts.chart_timeline(stats.timeline(t, "all", AS_OF)))

register("chart_items", oracle_prelude("shop_orders", "order_items") + f"""
SELECT CASE WHEN length(item_name) > 20 THEN left(item_name, 20) || '...' ELSE item_name END AS label,
  total_quantity AS quantities, total_revenue AS revenues,
  CAST(row_number() OVER (ORDER BY total_quantity DESC, item_name ASC NULLS LAST, item_type ASC NULLS LAST)
    AS BIGINT) AS position
FROM (
  SELECT oi.item_name, oi.item_type, CAST(COALESCE(SUM(oi.quantity), 0) AS BIGINT) AS total_quantity,
    COALESCE(CAST(SUM(oi.total) AS DOUBLE), 0) AS total_revenue
  FROM order_items oi JOIN shop_orders o ON oi.order_id = o.order_id
  WHERE {bounds_sql('all', 'o.order_date')}
  GROUP BY oi.item_name, oi.item_type
  ORDER BY total_quantity DESC, oi.item_name ASC NULLS LAST, oi.item_type ASC NULLS LAST LIMIT 10)""")(
    lambda t: charts.chart_items(stats.top_items(t, "all", AS_OF)))

_STATUS_LABEL = "upper(substr(coalesce(status, 'unknown'), 1, 1)) || lower(substr(coalesce(status, 'unknown'), 2))"
register("chart_status", oracle_prelude("shop_orders") + f"""
SELECT {_STATUS_LABEL} AS label, count AS value,
  CASE lower({_STATUS_LABEL}) WHEN 'pending' THEN '#ffc107' WHEN 'confirmed' THEN '#17a2b8'
    WHEN 'processing' THEN '#007bff' WHEN 'shipped' THEN '#6f42c1' WHEN 'delivered' THEN '#28a745'
    WHEN 'cancelled' THEN '#dc3545' ELSE '#6c757d' END AS color,
  CAST(row_number() OVER (ORDER BY status NULLS FIRST) AS BIGINT) AS position
FROM (SELECT status, COUNT(*) AS count FROM shop_orders
  WHERE {bounds_sql('all')} GROUP BY status)""")(
    lambda t: charts.chart_status(stats.status_distribution(t, "all", AS_OF)))


# --- X*, M*: formatting over whole tables --------------------------------------------

from orderlens.functions import format as fmt  # noqa: E402

register("fmt_currency", oracle_prelude("shop_orders") + f"""
SELECT order_id, {_RUPEE % 'total_amount'} AS total_amount_formatted,
  {_RUPEE % '(-total_amount)'} AS negative_formatted FROM shop_orders""")(
    lambda t: t.orders.select("order_id", fmt.currency("total_amount").alias("total_amount_formatted"),
                              fmt.currency(-F.col("total_amount")).alias("negative_formatted")))

register("fmt_datetime", oracle_prelude("shop_orders") + f"""
SELECT order_id, {_DT_FMT % 'order_date'} AS order_date_text,
  coalesce(strftime(order_date, '%I:%M %p'), '') AS order_time_text,
  coalesce(strftime(order_date, '%d %b %I:%M %p'), '') AS order_short_text FROM shop_orders""")(
    lambda t: t.orders.select("order_id", fmt.datetime_text("order_date").alias("order_date_text"),
                              fmt.datetime_text("order_date", fmt.TIME_FORMAT).alias("order_time_text"),
                              fmt.datetime_text("order_date", fmt.CHART_LABEL_FORMAT).alias("order_short_text")))

# Asia/Kolkata has been UTC+05:30 without daylight saving since 1945.
register("fmt_datetime_ist", oracle_prelude("shop_orders") + f"""
SELECT order_id, order_date + INTERVAL 330 MINUTE AS order_date_ist,
  {_DT_FMT % '(order_date + INTERVAL 330 MINUTE)'} AS order_date_ist_text,
  coalesce(strftime(delivery_date + INTERVAL 330 MINUTE, '%d %b %Y, %I:%M %p'), 'N/A') AS delivery_text
FROM shop_orders""")(
    lambda t: t.orders.select("order_id", fmt.to_display_zone("order_date").alias("order_date_ist"),
                              fmt.datetime_text("order_date", convert=True).alias("order_date_ist_text"),
                              fmt.datetime_text_or_na("delivery_date").alias("delivery_text")))


def _as_text(t):
    raw = F.when(F.col("order_id") % 10 == 0, F.lit("not a date")).otherwise(F.col("order_date").cast("string"))
    return t.orders.select("order_id", raw.alias("raw"))


register("fmt_datetime_text", oracle_prelude("shop_orders") + """
SELECT order_id, raw, coalesce(strftime(try_strptime(raw, '%Y-%m-%d %H:%M:%S'), '%d %b %Y, %I:%M %p'), raw, '')
  AS text
FROM (SELECT order_id, CASE WHEN order_id % 10 = 0 THEN 'not a date' ELSE CAST(order_date AS VARCHAR) END AS raw
  FROM shop_orders)""")(
    lambda t: _as_text(t).select("order_id", "raw", fmt.datetime_text_from_string("raw").alias("text")))

register("truncate_text", oracle_prelude("menu") + """
SELECT id, CASE WHEN length(description) > 50 THEN left(description, 50) || '...' ELSE description END
    AS description_short,
  CASE WHEN length(name) > 20 THEN left(name, 20) || '...' ELSE name END AS name_short,
  CASE WHEN length(description) > 20 THEN left(description, 20) || '...' ELSE description END AS label
FROM menu""")(
    lambda t: t.menu.select("id", fmt.truncate("description", 50).alias("description_short"),
                            fmt.truncate("name", 20).alias("name_short"),
                            fmt.truncate("description", 20).alias("label")))

register("title_case", oracle_prelude("users") + """
SELECT id, list_aggregate(list_transform(string_split(lower(city), ' '), lambda x: upper(x[1]) || x[2:]),
    'string_agg', ' ') AS city_title,
  list_aggregate(list_transform(string_split(lower(state), ' '), lambda x: upper(x[1]) || x[2:]),
    'string_agg', ' ') AS state_title
FROM users""")(
    lambda t: t.users.select("id", fmt.title_case("city").alias("city_title"),
                             fmt.title_case("state").alias("state_title")))

_BADGE_SQL = """CASE lower(status) WHEN 'pending' THEN 'warning' WHEN 'confirmed' THEN 'info'
    WHEN 'processing' THEN 'primary' WHEN 'shipped' THEN 'purple' WHEN 'delivered' THEN 'success'
    WHEN 'cancelled' THEN 'danger' WHEN 'refunded' THEN 'secondary' ELSE 'secondary' END"""
register("status_badge", oracle_prelude("shop_orders") + f"""
SELECT order_id, status, {_BADGE_SQL} AS status_badge,
  {_BADGE_SQL.replace('lower(status)', 'lower(upper(status))')} AS upper_badge
FROM shop_orders""")(
    lambda t: t.orders.select("order_id", "status", fmt.status_badge("status").alias("status_badge"),
                              fmt.status_badge(F.upper("status")).alias("upper_badge")))

register("payment_badge", oracle_prelude("payments") + """
SELECT payment_id, CASE lower(payment_status) WHEN 'pending' THEN 'warning' WHEN 'completed' THEN 'success'
    WHEN 'failed' THEN 'danger' WHEN 'refunded' THEN 'secondary' WHEN 'processing' THEN 'info'
    ELSE 'secondary' END AS payment_badge
FROM payments""")(
    lambda t: t.payments.select("payment_id", fmt.payment_badge("payment_status").alias("payment_badge")))


def _coords(t):
    return t.users.select("id", (F.col("id") % 180 - 90).cast("int").alias("lat"),
                          (F.col("id") % 360 - 180).cast("int").alias("lon"))


register("map_link", oracle_prelude("users") + """
SELECT id, lat, lon, CASE WHEN lat <> 0 AND lon <> 0 THEN
  'https://www.google.com/maps?q=' || CAST(lat AS VARCHAR) || ',' || CAST(lon AS VARCHAR) END AS map_link
FROM (SELECT id, CAST(id % 180 - 90 AS INTEGER) AS lat, CAST(id % 360 - 180 AS INTEGER) AS lon FROM users)""")(
    lambda t: _coords(t).select("id", "lat", "lon", fmt.map_link("lat", "lon").alias("map_link")))


def _photos(t):
    url = F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://img.example.com/"), F.col("id").cast("string")))
    return t.menu.select("id", F.when(F.col("id") % 3 == 1, F.col("name")).otherwise(url).alias("photo_url"))


register("image_url", oracle_prelude("menu") + f"""
SELECT id, photo_url, CASE WHEN starts_with(photo_url, 'http') THEN photo_url ELSE '{DEFAULT_IMAGE}' END AS image
FROM (SELECT id, CASE WHEN id % 3 = 1 THEN name WHEN id % 3 = 0 THEN 'https://img.example.com/' ||
  CAST(id AS VARCHAR) END AS photo_url FROM menu)""")(
    lambda t: _photos(t).select("id", "photo_url", fmt.image_url("photo_url").alias("image")))

register("location_text", oracle_prelude("users") + """
SELECT id, CASE WHEN city IS NULL OR city = '' THEN 'N/A' WHEN state IS NULL OR state = '' THEN city
  ELSE city || ', ' || state END AS location,
  CASE WHEN is_active THEN 'Active' ELSE 'Inactive' END AS active_text,
  concat_ws(chr(10), nullif(city, ''), nullif(state, '')) AS address_text,
  coalesce(CAST(NULL AS VARCHAR), 'Never') AS last_login_text
FROM users""")(
    lambda t: t.users.select("id", fmt.location_text("city", "state").alias("location"),
                             fmt.active_text("is_active").alias("active_text"),
                             fmt.address_block("city", "state").alias("address_text"),
                             fmt.or_default(F.lit(None).cast("string"), "Never").alias("last_login_text")))

register("two_decimals", oracle_prelude("order_items") + """
SELECT order_item_id, order_id, item_id, printf('%.2f', CAST(total AS DOUBLE)) AS total_text FROM order_items""")(
    lambda t: t.order_items.select("order_item_id", "order_id", "item_id",
                                   fmt.two_decimals("total").alias("total_text")))


# --- V14: stream jobs (run to completion over the available files) ----------------------

from orderlens.sources.fixtures import derive_streaming  # noqa: E402
from orderlens.streaming import live  # noqa: E402


def _live_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = derive_streaming(spark, sf_dir, "shop_orders", "orders")
    return for_check(live.live_timeline(spark, stream))


def _stream_status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = shop_tables(spark, sf_dir)
    stream = derive_streaming(spark, sf_dir, "status_updates", "events")
    return for_check(live.stream_status_updates(stream, t.orders))


QUERIES["live_timeline"] = _live_timeline
ORACLE["live_timeline"] = oracle_prelude("shop_orders") + """
SELECT date_trunc('hour', order_date) AS period, COUNT(*) AS order_count,
  COALESCE(CAST(SUM(total_amount) AS DOUBLE), 0) AS total_revenue
FROM shop_orders WHERE order_date IS NOT NULL GROUP BY 1"""
QUERIES["status_updates_stream_log"] = _stream_status_log
ORACLE["status_updates_stream_log"] = ORACLE["status_updates_log"]


# --- display layers, log order ----------------------------------------------------

register("orders_page_display", oracle_prelude("shop_orders", "order_items", "payments", extra=(_FIRST_PAYMENT,)) + f"""
SELECT pg.*, coalesce(p.payment_status, 'pending') AS payment_status,
  {_BADGE_SQL} AS status_badge,
  CASE lower(coalesce(p.payment_status, 'pending')) WHEN 'pending' THEN 'warning' WHEN 'completed' THEN 'success'
    WHEN 'failed' THEN 'danger' WHEN 'refunded' THEN 'secondary' WHEN 'processing' THEN 'info'
    ELSE 'secondary' END AS payment_badge,
  {_RUPEE % 'pg.total_amount'} AS total_amount_formatted, {_DT_FMT % 'pg.order_date'} AS order_date_formatted
FROM (
  SELECT o.order_id, o.user_name, o.user_phone, o.user_email, CAST(o.total_amount AS DOUBLE) AS total_amount,
    o.payment_mode, o.delivery_location, o.status, o.order_date, o.delivery_date,
    COUNT(oi.order_item_id) AS item_count
  FROM shop_orders o LEFT JOIN order_items oi ON o.order_id = oi.order_id
  WHERE o.status = 'cancelled'
  GROUP BY o.order_id, o.user_name, o.user_phone, o.user_email, o.total_amount, o.payment_mode,
    o.delivery_location, o.status, o.order_date, o.delivery_date
  ORDER BY o.order_date DESC NULLS FIRST, o.order_id DESC LIMIT 20 OFFSET 20) pg
LEFT JOIN first_payment p ON p.order_id = pg.order_id""")(
    lambda t: orders.with_display(orders.list_orders(t, page=2, status="cancelled"), t))

register("customers_page_display", oracle_prelude("users", "shop_orders") + f"""
SELECT c.*, {_DT_FMT % 'c.created_at'} AS created_at_formatted,
  {_DT_FMT % 'c.last_order_date'} AS last_order_date_formatted,
  {_RUPEE % 'c.total_spent'} AS total_spent_formatted,
  CASE WHEN c.city IS NULL OR c.city = '' THEN 'N/A' WHEN c.state IS NULL OR c.state = '' THEN c.city
    ELSE c.city || ', ' || c.state END AS location,
  CASE WHEN c.is_active THEN 'Active' ELSE 'Inactive' END AS active_text,
  CASE WHEN c.total_orders > 0 THEN {_DT_FMT % 'c.last_order_date'} ELSE 'No orders' END AS last_order_text
FROM (
  SELECT u.id, u.full_name, u.phone, u.email, u.city, u.state, u.is_active,
    CAST(u.created_at AS TIMESTAMP) AS created_at, COUNT(o.order_id) AS total_orders,
    COALESCE(CAST(SUM(o.total_amount) AS DOUBLE), 0) AS total_spent, MAX(o.order_date) AS last_order_date
  FROM users u LEFT JOIN shop_orders o ON u.id = o.user_id
  GROUP BY u.id, u.full_name, u.phone, u.email, u.city, u.state, u.is_active, u.created_at
  ORDER BY u.created_at DESC NULLS FIRST, u.id DESC LIMIT 20 OFFSET 40) c""")(
    lambda t: customers.with_display(customers.list_customers(t, page=3)))

register("order_logs_desc", ORACLE["status_updates_log"])(
    lambda t: dossiers.order_logs_sorted(updates.apply_status_updates(t.orders, t.status_updates).logs))


# --- V6 bundle: the statistics page in one pass over orders ----------------------------

for _p, _u, _tl in (("month", "day", "month_day"), ("today", "hour", "today_hour"), ("all", "month", "all_month")):
    register(f"statistics_{_p}_totals", ORACLE[f"totals_{_p}"])(
        lambda t, p=_p: stats.order_statistics(t, p, AS_OF).totals)
    register(f"statistics_{_p}_timeline", ORACLE[f"timeline_{_tl}"])(
        lambda t, p=_p: stats.order_statistics(t, p, AS_OF).orders_timeline)
register("statistics_month_status", ORACLE["status_distribution_month"])(
    lambda t: stats.order_statistics(t, "month", AS_OF).status_distribution)
register("statistics_all_status", ORACLE["status_distribution_all"])(
    lambda t: stats.order_statistics(t, "all", AS_OF).status_distribution)


# --- nested dossier parts, compared flattened ------------------------------------------

def _exploded(chunks: DataFrame, key: str, alias: str) -> DataFrame:
    return chunks.select(key, F.explode(alias).alias("_e")).select(key, "_e.*").drop("position")


register("order_item_chunks_flat", ORACLE["order_items_named"])(
    lambda t: _exploded(dossiers.order_item_chunks(t, chunk_size=3), "order_id", "items"))
register("address_chunks_flat", ORACLE["customer_addresses"])(
    lambda t: _exploded(dossiers.address_chunks(t, chunk_size=1), "user_id", "addresses"))


def _order_addresses_sql(where: str) -> str:
    return oracle_prelude("shop_orders", "users", "addresses") + f"""
SELECT o.order_id, a.*, CASE WHEN a.is_default IS NULL THEN 0 WHEN a.is_default THEN 1 ELSE 2 END AS default_rank
FROM shop_orders o JOIN users u ON u.id = o.user_id JOIN addresses a ON a.user_id = o.user_id
WHERE o.user_id <> 0 AND {where}"""


def _order_addresses(t, ids=None) -> DataFrame:
    chunks = dossiers.order_address_chunks(t, ids, chunk_size=2)
    return chunks.select("order_id", "user_id", F.explode("addresses").alias("_e")).select("order_id", "user_id", "_e.*").drop("position")


register("order_dossier_addresses", _order_addresses_sql("TRUE"))(_order_addresses)


# --- remaining periods, unfiltered counts, keyset paging ------------------------------

for _p in ("yesterday", "last_month"):
    register(f"top_items_{_p}", _top_items_sql(_p))(lambda t, p=_p: stats.top_items(t, p, AS_OF))
for _p in ("today", "yesterday", "week", "last_month"):
    register(f"status_distribution_{_p}", _status_sql(_p))(
        lambda t, p=_p: stats.status_distribution(t, p, AS_OF))

register("orders_count_all", oracle_prelude("shop_orders") + """
SELECT COUNT(*) AS total FROM shop_orders""")(lambda t: orders.count_orders(t))
register("customers_count_all", oracle_prelude("users") + """
SELECT COUNT(*) AS total FROM users""")(lambda t: customers.count_customers(t))


def _keyset_second_page(t):
    """Page 2 reached by seeking past the last row of page 1."""
    last = orders.list_orders(t, page=1).orderBy(F.asc_nulls_last("order_date"), F.asc("order_id")).first()
    return orders.list_orders(t, after=(last["order_date"], last["order_id"]))


register("orders_keyset_page", _orders_list_sql(orders.LIST_COLUMNS, "TRUE", 20, 20))(_keyset_second_page)


register("fmt_browser_datetime", oracle_prelude("shop_orders") + """
SELECT order_id, raw,
  CASE WHEN raw IS NULL OR raw = '' THEN 'N/A'
    ELSE coalesce(strftime(try_strptime(raw, '%Y-%m-%d %H:%M:%S') + INTERVAL 330 MINUTE, '%d %b %Y, %I:%M %p'), raw)
  END AS text
FROM (SELECT order_id, CASE WHEN order_id % 10 = 0 THEN 'not a date' WHEN order_id % 10 = 1 THEN ''
  ELSE CAST(order_date AS VARCHAR) END AS raw FROM shop_orders)""")(
    lambda t: t.orders.select("order_id", F.when(F.col("order_id") % 10 == 0, F.lit("not a date"))
                              .when(F.col("order_id") % 10 == 1, F.lit(""))
                              .otherwise(F.col("order_date").cast("string")).alias("raw"))
    .select("order_id", "raw", fmt.browser_datetime_text("raw").alias("text")))



def _keyset_second_customer_page(t):
    """Customer page 2 reached by seeking past the last row of page 1."""
    last = customers.list_customers(t, page=1).orderBy(F.asc_nulls_last("created_at"), F.asc("id")).first()
    return customers.list_customers(t, after=(last["created_at"], last["id"]))


register("customers_keyset_page", _customers_sql("TRUE", 20, 20))(_keyset_second_customer_page)


# --- search through the trigram index, deep pages ------------------------------------------

from orderlens.sources.search_index import SearchIndex, customer_index, order_index  # noqa: E402
from orderlens.session import ensure_checkpoint_dir  # noqa: E402

# Tables that the store-backed queries derive from the shop tables, once per session and folder (as the
# fixtures are): a shop would build them once and keep them up to date.
_BUILT: dict[tuple[int, str], tuple] = {}


def _built(t, name: str, build: Callable):
    key = (id(t), name)
    if key not in _BUILT:
        spark = t.orders.sparkSession
        root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        _BUILT[key] = (t, build(spark, root))  # t is kept, so that its id is not given to another
    return _BUILT[key][1]


def _order_index(t) -> SearchIndex:
    def build(spark, root):
        index = order_index(spark, root)
        # in two batches that share blocks, as a table that has grown
        index.add(t.orders.where(F.col("order_id") % 3 != 0), 0)
        index.add(t.orders.where(F.col("order_id") % 3 == 0), 1)
        return index
    return _built(t, "order-index", build)


def _customer_index(t) -> SearchIndex:
    def build(spark, root):
        index = customer_index(spark, root)
        index.add(t.users)
        return index
    return _built(t, "customer-index", build)


register("orders_search_indexed", ORACLE["orders_search"])(
    lambda t: orders.list_orders(t, search="#0000011", index=_order_index(t)))
register("orders_search_indexed_wildcard", _orders_list_sql(
    orders.LIST_COLUMNS, "o.status = 'delivered' AND " + _search_sql("omer.00%01_@EXA", _ORDER_SEARCH_COLS), 20))(
    lambda t: orders.list_orders(t, status="delivered", search="omer.00%01_@EXA", index=_order_index(t)))
register("orders_search_indexed_parts", _orders_list_sql(
    orders.LIST_COLUMNS, _search_sql("STOMER.0000%1@EXAM", _ORDER_SEARCH_COLS), 20, 20))(
    lambda t: orders.list_orders(t, page=2, search="STOMER.0000%1@EXAM", index=_order_index(t)))
register("orders_search_indexed_short", ORACLE["orders_search_wildcard"])(
    lambda t: orders.list_orders(t, status="delivered", search="9_0%12", index=_order_index(t)))
register("orders_search_indexed_none", _orders_list_sql(
    orders.LIST_COLUMNS, _search_sql("nobody of this name", _ORDER_SEARCH_COLS), 20))(
    lambda t: orders.list_orders(t, search="nobody of this name", index=_order_index(t)))
register("orders_count_indexed", ORACLE["orders_count_filtered"])(
    lambda t: orders.count_orders(t, status="shipped", search="0001", index=_order_index(t)))
register("customers_search_indexed", ORACLE["customers_search"])(
    lambda t: customers.list_customers(t, search="customer#00000", index=_customer_index(t)))

# 15,000 orders and 1,500 customers at sf 0.01; an empty page at smaller sizes
register("orders_page_deep", _orders_list_sql(orders.LIST_COLUMNS, "TRUE", 20, 12_340))(
    lambda t: orders.list_orders(t, page=618))
register("orders_page_deep_status", _orders_list_sql(orders.LIST_COLUMNS, "o.status = 'pending'", 7, 1_400))(
    lambda t: orders.item_counts_for(deep_page(orders.filtered_orders(t, "pending").select(*orders.LIST_COLUMNS),
                                               "order_date", "order_id", 201, 7), t, 7))


def _deep_customers(t) -> DataFrame:
    top = deep_page(t.users, "created_at", "id", 71, 20).select("id")
    return customers.customer_metrics(t).join(F.broadcast(top), "id", "left_semi")  # a page of ids


register("customers_page_deep", _customers_sql("TRUE", 20, 1_400))(_deep_customers)


# --- period figures from the hourly roll-up ------------------------------------------------

from orderlens.sources import rollup  # noqa: E402


def _rollup(t):
    """The roll-up of the orders, and after it that of two batches of status updates: (store, orders) of each."""
    def build(spark, root):
        fresh = rollup.rollup_store(spark, f"{root}/fresh")
        rollup.add_orders(fresh, 0, t.orders.where(F.col("order_id") % 2 == 0))
        rollup.add_orders(fresh, 1, t.orders.where(F.col("order_id") % 2 != 0))
        changed = rollup.rollup_store(spark, f"{root}/changed", fanout=2)
        rollup.add_orders(changed, 0, t.orders)
        when = F.unix_micros(ntz_to_instant("created_at"))
        early = when <= F.lit(t.status_updates.agg(F.percentile_approx(when, 0.5)).first()[0])
        now = t.orders
        for batch, part in ((1, t.status_updates.where(early)), (2, t.status_updates.where(~early))):
            result = updates.apply_status_updates(now, part)
            changes = materialize(result.changes)
            rollup.change_statuses(changed, batch, now, changes)
            # only the changes are kept, the orders after them stay a view: what reads it filters the stored orders first
            now = updates.current_status(now, changes.select("order_id", F.col("status").alias("_new")))
        return {"fresh": (fresh, t.orders), "changed": (changed, now)}
    return _built(t, "order-rollup", build)


def _updated_sql(sql: str) -> str:
    """A query of ``shop_orders`` over the orders after all status updates."""
    orders_now = """orders_now AS (SELECT o.* REPLACE (CASE WHEN l.order_id IS NOT NULL THEN l.new_status ELSE o.status END AS status)
  FROM shop_orders o LEFT JOIN last_update l ON l.order_id = o.order_id)"""
    body = sql[sql.index("SELECT", len(oracle_prelude("shop_orders")) - 1):]
    return (oracle_prelude("shop_orders", "status_updates", extra=(*_UPDATE_CTES, orders_now))
            + body.replace("FROM shop_orders", "FROM orders_now"))


for _p in ("today", "yesterday", "week", "month", "last_month", "all"):
    register(f"rollup_totals_{_p}", ORACLE[f"totals_{_p}"])(
        lambda t, p=_p: rollup.totals(*_rollup(t)["fresh"], p, AS_OF))
    register(f"rollup_updated_totals_{_p}", _updated_sql(_totals_sql(_p)))(
        lambda t, p=_p: rollup.totals(*_rollup(t)["changed"], p, AS_OF))
    register(f"rollup_updated_status_{_p}", _updated_sql(_status_sql(_p)))(
        lambda t, p=_p: rollup.status_distribution(*_rollup(t)["changed"], p, AS_OF))
for _name, _p, _u in (("today_hour", "today", "hour"), ("week_day", "week", "day"), ("all_month", "all", "month")):
    register(f"rollup_timeline_{_name}", ORACLE[f"timeline_{_name}"])(
        lambda t, p=_p, u=_u: rollup.timeline(*_rollup(t)["fresh"], p, AS_OF, u))
