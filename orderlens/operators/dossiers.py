"""Order dossiers, customer dossiers and payment views in bulk.

The reference answers one order at a time with five dependent point queries.
Here every dossier part is built for ALL orders (or an ``ids`` subset) in one
job: each child table is reduced per key first (counts, one-row picks), then
left-joined to the parent on that key.  Consecutive joins on ``order_id``
reuse one hash partitioning, so the orders side is shuffled once for them.

Children with unbounded fan-out (items, addresses, logs) are returned flat,
keyed and carrying their sort keys; :func:`order_documents` renders JSON with
those children cut into pages by position (``plans.positions``).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.functions import format as fmt
from orderlens.plans.joins import attach_counts, pick_one
from orderlens.plans.lineage import materialize_parquet, step
from orderlens.plans.positions import nest_pages
from orderlens.plans.slices import in_slices, slices
from orderlens.sources.tables import Tables

#: Keys that go to a scan as a literal list; more become a table of keys and a semi join.
MAX_LITERAL_KEYS = 1000

#: The folder column of the partitioned layout, no part of an order.
LAYOUT_COLUMN = "order_month"

# Fixed value: the label of an item whose type is neither service nor menu.
UNKNOWN_ITEM = "Unknown Item"


def _keys(ids: Iterable[int] | DataFrame | None) -> tuple[int, ...] | DataFrame | None:
    """Keys that several tables are restricted to: an iterator is read once."""
    return ids if ids is None or isinstance(ids, DataFrame) else tuple(ids)


def _only(df: DataFrame, col: str, ids: Iterable[int] | DataFrame | None) -> DataFrame:
    """restrict to the given keys (a list, or a DataFrame of keys)."""
    if ids is None:
        return df
    if not isinstance(ids, DataFrame) and len(ids) > MAX_LITERAL_KEYS:  # too many for a pushed list
        ids = df.sparkSession.createDataFrame([(i,) for i in set(ids)], f"{col} long")
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(col)), col, "left_semi")
    return df.where(F.col(col).isin(list(ids)))


def col_or_null(df: DataFrame, name: str, dtype: T.DataType) -> F.Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype).alias(name)


def _leading(df: DataFrame, *needed: str) -> DataFrame:
    """The columns up to the last one needed: those before it break ties of a pick, those after it cannot."""
    last = max(df.columns.index(c) for c in needed)
    return df.select(*df.columns[:last + 1])


def catalogue_names(t: Tables) -> DataFrame:
    """``(item_type, id, name)`` of both catalogues under one type tag."""
    return (t.services.select(F.lit("service").alias("_type"), F.col("id").alias("_id"), F.col("name").alias("_name"))
            .unionByName(t.menu.select(F.lit("menu").alias("_type"), F.col("id").alias("_id"),
                                       F.col("name").alias("_name"))))


def named_items(t: Tables, ids=None) -> DataFrame:
    """P7 + J4/J5 + O6: order items with their catalogue name.

    ``CASE type WHEN service THEN s.name WHEN menu THEN m.name ELSE 'Unknown
    Item'``; a typed item without a catalogue match gets NULL.  The two
    one-sided left joins of the reference (``ON type = 'service' AND id =
    s.id`` and the same for menu) are one equi-join on ``(type, id)`` against
    the tagged union of both catalogues: same rows, one pass over the items.
    AQE plans the join from measured sizes: a small union is broadcast, and a
    hot item's skewed partition is split.
    """
    ids = _keys(ids)
    items = _only(t.order_items, "order_id", ids)
    joined = items.join(catalogue_names(t), (F.col("item_type") == F.col("_type")) & (F.col("item_id") == F.col("_id")), "left")
    it = F.col("item_type")
    full = F.when(it.isin("service", "menu"), F.col("_name")).otherwise(F.lit(UNKNOWN_ITEM))
    return (joined.withColumn("full_name", full)
            .withColumn("price_formatted", fmt.currency("price"))
            .withColumn("total_formatted", fmt.currency("total"))
            .drop("_type", "_id", "_name"))


def default_addresses(t: Tables) -> DataFrame:
    """J6 + W1: each user's default address (lowest id among defaults)."""
    defaults = t.addresses.where(F.col("is_default"))
    return pick_one(defaults, "user_id", ["id"], "address")


def first_payments(t: Tables, ids=None) -> DataFrame:
    """J9 + W1: one payment per order, the lowest ``payment_id``."""
    ids = _keys(ids)
    return pick_one(_only(t.payments, "order_id", ids), "order_id", ["payment_id"], "payment")


def customers_with_default_address(t: Tables) -> DataFrame:
    """D6 done right: ``user`` and ``address`` as two structs, never merged."""
    users = t.users.select(F.col("id").alias("user_id"), F.struct(*[F.col(c) for c in t.users.columns]).alias("user"))
    return users.join(default_addresses(t), "user_id", "left")


def item_counts_by_order(t: Tables, ids=None) -> DataFrame:
    """Per order: ``item_count`` (COUNT(order_item_id)) and ``_n`` (rows)."""
    ids = _keys(ids)
    return (_only(t.order_items, "order_id", ids).groupBy("order_id")
            .agg(F.count("order_item_id").alias("item_count"), F.count(F.lit(1)).alias("_n")))


def order_headers(t: Tables, ids=None, counts: DataFrame | None = None, customers: DataFrame | None = None) -> DataFrame:
    """V3 header: every order column, formatted fields, item count, payment
    struct and customer (user + default address).  ``customer`` is NULL when
    the order has no user (NULL or 0 id, F12) or the user is unknown.
    ``customers`` are those of :func:`customers_with_default_address`, if there."""
    ids = _keys(ids)
    orders = _only(t.orders, "order_id", ids)
    counts = counts if counts is not None else item_counts_by_order(t, ids)
    out = attach_counts(orders, counts.select("order_id", "item_count"), "order_id", "item_count")
    out = out.join(first_payments(t, ids), "order_id", "left")
    cust = customers if customers is not None else customers_with_default_address(t)
    has_user = F.col("user_id").isNotNull() & (F.col("user_id") != 0)
    out = out.join(cust.withColumnRenamed("user_id", "_uid"),
                   has_user & (F.col("user_id") == F.col("_uid")), "left")
    customer = F.when(F.col("user").isNotNull(), F.struct("user", "address"))
    return (out.withColumn("customer", customer).drop("_uid", "user", "address")
            .withColumn("order_date_formatted", fmt.datetime_text("order_date"))
            .withColumn("total_amount_formatted", fmt.currency("total_amount")))


def order_dossier_flat(t: Tables, ids=None) -> DataFrame:
    """The header flattened to columns (for comparison and tabular export)."""
    ids = _keys(ids)
    # only what is returned goes through the picks and the joins
    few = t.with_tables(payments=_leading(t.payments, "payment_id", "order_id", "amount", "payment_status"),
                        users=t.users.select("id", "full_name", "email"),
                        addresses=_leading(t.addresses, "id", "user_id", "is_default", "city"))
    h = order_headers(few, ids)
    return h.select(
        *[c for c in t.orders.columns if c != LAYOUT_COLUMN], "item_count", "order_date_formatted", "total_amount_formatted",
        F.col("payment.payment_id").alias("payment_id"),
        F.col("payment.payment_status").alias("payment_status"),
        F.col("payment.amount").alias("payment_amount"),
        F.col("customer.user.full_name").alias("customer_name"),
        F.col("customer.user.email").alias("customer_email"),
        F.col("customer.address.id").alias("default_address_id"),
        F.col("customer.address.city").alias("default_address_city"),
    )


def order_logs_sorted(logs: DataFrame, ids=None) -> DataFrame:
    """J10 + O8: log rows of the orders, newest first by (created_at, log_id)."""
    ids = _keys(ids)
    return _only(logs, "order_id", ids).orderBy("order_id", F.desc_nulls_first("created_at"), F.desc("log_id"))


def order_item_chunks(t: Tables, ids=None, chunk_size: int = 500) -> DataFrame:
    """J11 + A17 + O6: each order's named items in pages of ``chunk_size``,
    ``(order_id, part, parts, items)``; an order without items has an empty page."""
    ids = _keys(ids)
    items = named_items(t, ids)
    lead = ["order_id", "order_item_id", "item_id", "total"]
    items = items.select(*lead, *[c for c in items.columns if c not in lead])
    return nest_pages(items, _only(t.orders, "order_id", ids), "order_id",
                      [F.asc_nulls_first("order_item_id"), F.asc_nulls_first("item_id"), F.asc_nulls_first("total")], chunk_size, "items",
                      weigh=_only(t.order_items, "order_id", ids))


def address_chunks(t: Tables, ids=None, chunk_size: int = 500) -> DataFrame:
    """J8 + O7 + A17: each user's addresses, default first, in pages of
    ``chunk_size``, ``(user_id, part, parts, addresses)``; a user without
    addresses has an empty page."""
    ids = _keys(ids)
    from orderlens.operators.customers import addresses_ranked

    addr = _only(addresses_ranked(t), "user_id", ids)
    lead = ["user_id", "default_rank", "id"]
    addr = addr.select(*lead, *[c for c in addr.columns if c not in lead])
    users = _only(t.users.select(F.col("id").alias("user_id")), "user_id", ids)
    return nest_pages(addr, users, "user_id", [F.col("default_rank").asc(), F.asc_nulls_first("id")], chunk_size, "addresses")


def order_address_chunks(t: Tables, ids=None, chunk_size: int = 500) -> DataFrame:
    """J8 + O7 in V3: all addresses of each order's customer, default first,
    ``(order_id, user_id, part, parts, addresses)``; an empty page where the
    order has no known user or the user no address.  A user's addresses are
    nested once, then meet the orders."""
    ids = _keys(ids)
    has_user = F.col("user_id").isNotNull() & (F.col("user_id") != 0)
    orders = _only(t.orders, "order_id", ids).select("order_id", F.when(has_user, F.col("user_id")).alias("user_id"))
    owners = None if ids is None else orders.where("user_id IS NOT NULL").select("user_id").distinct()
    chunks = address_chunks(t, owners, chunk_size)
    none = F.slice(F.array(F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in chunks.schema["addresses"].dataType.elementType])), 1, 0)
    # orders without a user are told apart, so that they do not meet in one task
    with_user = orders.where("user_id IS NOT NULL").join(chunks, "user_id", "left")
    without = orders.where("user_id IS NULL").select(
        "user_id", "order_id", *[F.lit(None).cast(chunks.schema[c].dataType).alias(c) for c in ("part", "parts", "addresses")])
    return with_user.unionByName(without).select(
        "order_id", "user_id", F.coalesce("part", F.lit(0).cast("long")).alias("part"),
        F.coalesce("parts", F.lit(1).cast("long")).alias("parts"), F.coalesce("addresses", none).alias("addresses"))


def log_chunks(t: Tables, logs: DataFrame, ids=None, chunk_size: int = 500) -> DataFrame:
    """J10 + O8 + A17: each order's log, newest first, in pages of
    ``chunk_size``, ``(order_id, part, parts, logs)``; an empty page without any."""
    ids = _keys(ids)
    lg = _only(logs, "order_id", ids)
    lead = ["order_id", "created_at", "log_id"]
    lg = lg.select(*lead, *[c for c in lg.columns if c not in lead])
    return nest_pages(lg, _only(t.orders, "order_id", ids), "order_id", [F.desc_nulls_first("created_at"), F.desc("log_id")], chunk_size, "logs")


def order_documents(t: Tables, ids=None, chunk_size: int = 500, logs: DataFrame | None = None) -> DataFrame:
    """Dossiers as JSON documents ``(order_id, section, part, parts, json)``.

    ``section`` is ``order`` (header, customer, payment: one document per
    order), ``items``, ``addresses`` (all of the customer's, default first) or
    ``logs`` (newest first): lists in pages of ``chunk_size`` elements with
    their positions, an empty list where an order has none.  Sections are
    unioned, never joined to each other, so no order's items are paired with
    its logs.  Of tables above ``slices.SLICE_BYTES`` the rows of all sections
    but the addresses are computed and stored by slices of the order id.
    """
    ids = _keys(ids)
    spark, given = t.orders.sparkSession, logs is not None
    logs = logs if given else t.order_logs
    order_cols = [c for c in t.orders.columns if c != LAYOUT_COLUMN]

    def header(some: Tables, customers: DataFrame | None = None) -> DataFrame:
        return order_headers(some, ids, customers=customers).select(
            *order_cols, "order_date_formatted", "total_amount_formatted", "item_count", "customer", "payment")

    own = [t.orders, t.order_items, t.payments, *([logs] if logs is not None else [])]
    few = isinstance(ids, tuple) and len(ids) <= MAX_LITERAL_KEYS
    parts = [] if few else slices(own, "order_id")
    if len(parts) > 1:
        with step(spark):
            customers = materialize_parquet(customers_with_default_address(t))
            every = materialize_parquet(logs) if given else logs  # what computes them runs once

            def within(where: Column) -> Tables:
                return t.with_tables(orders=t.orders.where(where), order_items=t.order_items.where(where), payments=t.payments.where(where))

            made = {"order": lambda where: header(within(where), customers), "items": lambda where: order_item_chunks(within(where), ids, chunk_size)}
            if logs is not None:
                made["logs"] = lambda where: log_chunks(within(where), every.where(where), ids, chunk_size)
            sections = in_slices(spark, parts, made)
    else:
        sections = {"order": header(t), "items": order_item_chunks(t, ids, chunk_size)}
        if logs is not None:
            sections["logs"] = log_chunks(t, logs, ids, chunk_size)
    sections["addresses"] = order_address_chunks(t, ids, chunk_size)
    docs = _document(sections["order"].select(
        "order_id", F.lit("order").alias("section"), F.lit(0).cast("long").alias("part"),
        F.lit(1).cast("long").alias("parts"),
        F.struct(*order_cols, "order_date_formatted", "total_amount_formatted", "item_count").alias("order"),
        "customer", "payment"), "order_id")
    for name in ("items", "addresses", "logs"):
        if name in sections:
            docs = docs.unionByName(_document(sections[name].select("order_id", F.lit(name).alias("section"), "part", "parts", name), "order_id"))
    return docs


# What an element of each section is told by when documents are read back: id, label, amount, time.
_ELEMENTS = {
    "items": ("order_item_id bigint, full_name string, total decimal(18,2)", ("order_item_id", "full_name", "total", None)),
    "addresses": ("id bigint, city string", ("id", "city", None, None)),
    "logs": ("log_id bigint, new_status string, created_at string", ("log_id", "new_status", None, "created_at")),
    "orders": ("order_id bigint, status string, total_amount decimal(18,2), order_date string", ("order_id", "status", "total_amount", "order_date")),
}


def document_elements(docs: DataFrame, key: str) -> DataFrame:
    """JSON documents read back: ``(key, section, part, parts, position, id,
    label, amount, at_time)``, a row for each list element, one with NULLs for an
    empty list, and one for each order or user section."""
    schema = ", ".join([*(f"{name}: array<struct<position: bigint, recent_rank: bigint, {', '.join(f.replace(' ', ': ', 1) for f in fields.split(', '))}>>"
                          for name, (fields, _) in _ELEMENTS.items()),
                        "`order`: struct<order_id: bigint, status: string, total_amount: decimal(18,2), order_date: string>",
                        "user: struct<id: bigint, full_name: string>, stats: struct<total_spent: decimal(18,2), total_orders: bigint>"])
    kinds = ("string", "string", "decimal(18,2)", "string")

    def told(source: Column, names: Sequence[str | None], position: Column) -> Column:
        return F.struct(position.alias("position"), *[(source[n] if n else F.lit(None)).cast(kind).alias(alias)
                                                      for n, kind, alias in zip(names, kinds, ("id", "label", "amount", "at_time"))])

    doc = F.col("_doc")
    parsed = docs.select(key, "section", "part", "parts", F.from_json("json", f"struct<{schema}>").alias("_doc"))
    def listed(name: str, names: Sequence[str | None]) -> Column:
        return F.transform(doc[name], lambda e: told(e, names, F.coalesce(e["position"], e["recent_rank"] - 1)))

    lists = [listed(name, names) for name, (_, names) in _ELEMENTS.items()]
    order = F.when(doc["order"].isNotNull(), F.array(told(doc["order"], ("order_id", "status", "total_amount", "order_date"), F.lit(0).cast("bigint"))))
    user = F.when(doc["user"].isNotNull(), F.array(F.struct(F.lit(0).cast("bigint").alias("position"), doc["user"]["id"].cast("string").alias("id"),
                                                           doc["user"]["full_name"].alias("label"), doc["stats"]["total_spent"].alias("amount"),
                                                           F.lit(None).cast("string").alias("at_time"))))
    return (parsed.select(key, "section", "part", "parts", F.explode_outer(F.coalesce(*lists, order, user)).alias("_e"))
            .select(key, "section", "part", "parts", "_e.*"))


def _document(df: DataFrame, key: str) -> DataFrame:
    """Key columns plus the whole row as one self-describing JSON text."""
    return df.select(key, "section", "part", "parts", fmt.to_json_record(*df.columns).alias("json"))


def write_documents(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K3: export documents as JSON lines, one folder per section."""
    docs.select("section", "json").write.mode(mode).partitionBy("section").text(path)


# --- V12: payment view ---------------------------------------------------------

def payment_details(t: Tables, ids=None) -> DataFrame:
    """The payment panel of each order that has a payment.

    Customer name and payment mode come from the order; amount and date are
    formatted; the signature is masked to 30 characters.
    """
    ids = _keys(ids)
    pay = first_payments(t, ids).select("order_id", "payment.*")
    orders = _only(t.orders, "order_id", ids).select("order_id", "user_name", "payment_mode")
    p = pay.join(orders, "order_id", "left")
    date = col_or_null(p, "payment_date", T.TimestampNTZType())
    return p.select(
        "order_id", "payment_id", "user_name", "payment_mode", "payment_status",
        F.col("amount"),
        fmt.currency("amount").alias("amount_formatted"),
        fmt.payment_badge("payment_status").alias("payment_badge"),
        fmt.datetime_text_or_na(date).alias("payment_date_formatted"),
        col_or_null(p, "transaction_id", T.StringType()),
        col_or_null(p, "razorpay_order_id", T.StringType()),
        col_or_null(p, "razorpay_payment_id", T.StringType()),
        fmt.signature_mask(col_or_null(p, "razorpay_signature", T.StringType())).alias("signature_masked"),
    )


# --- V5: customer dossier --------------------------------------------------------

def customer_documents(t: Tables, ids=None, chunk_size: int = 500) -> DataFrame:
    """V5 as JSON documents ``(user_id, section, part, parts, json)``: the user
    with totals, the last 10 orders (bounded by construction), and the
    addresses (chunked)."""
    ids = _keys(ids)
    from orderlens.operators.customers import customer_stats, recent_orders

    users = _only(t.users, "id", ids)
    stats = customer_stats(t.with_tables(users=users))
    head = _document(users.withColumnRenamed("id", "user_id").join(stats, "user_id", "left").select(
        "user_id", F.lit("user").alias("section"), F.lit(0).cast("long").alias("part"),
        F.lit(1).cast("long").alias("parts"),
        F.struct(*[F.col(c) for c in users.columns if c != "id"], F.col("user_id").alias("id")).alias("user"),
        F.struct("total_orders", "total_spent", "avg_order_value",
                 fmt.currency("total_spent").alias("total_spent_formatted"),
                 fmt.currency("avg_order_value").alias("avg_order_value_formatted")).alias("stats")), "user_id")
    recent = recent_orders(t.with_tables(orders=_only(t.orders, "user_id", ids),
                                         orders_by_user=_only(t.user_orders, "user_id", ids)))
    order_cols = [c for c in recent.columns if c not in ("user_id", "recent_rank", LAYOUT_COLUMN)]
    listed = recent.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("recent_rank", *order_cols))).alias("orders"))
    none = F.slice(F.array(F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in listed.schema["orders"].dataType.elementType])), 1, 0)
    recent_docs = _document(
        users.select(F.col("id").alias("user_id")).join(listed, "user_id", "left").withColumn("orders", F.coalesce("orders", none))
        .select("user_id", F.lit("orders").alias("section"), F.lit(0).cast("long").alias("part"),
                F.lit(1).cast("long").alias("parts"), "orders"), "user_id")
    addr_docs = _document(
        address_chunks(t, ids, chunk_size)
        .select("user_id", F.lit("addresses").alias("section"), "part", "parts", "addresses"), "user_id")
    return head.unionByName(recent_docs).unionByName(addr_docs)


# --- V3 / V5 bundles ---------------------------------------------------------------

@dataclass(frozen=True)
class OrderDossiers:
    headers: DataFrame   # one row per order: order, item_count, payment, customer
    items: DataFrame     # one row per item, with catalogue name and sort key
    logs: DataFrame | None  # one row per log entry (newest first within an order)


def order_dossiers(t: Tables, ids=None, logs: DataFrame | None = None) -> OrderDossiers:
    """V3 for all orders (or ``ids``): the dossier's sections as flat, keyed
    DataFrames; :func:`order_documents` renders them as JSON."""
    ids = _keys(ids)
    logs = logs if logs is not None else t.order_logs
    return OrderDossiers(headers=order_headers(t, ids), items=named_items(t, ids),
                         logs=order_logs_sorted(logs, ids) if logs is not None else None)


@dataclass(frozen=True)
class CustomerDossiers:
    users: DataFrame          # user columns with total_orders, total_spent, avg_order_value
    addresses: DataFrame      # every address with its default_rank
    recent_orders: DataFrame  # last 10 orders per user with recent_rank


def customer_dossiers(t: Tables, ids=None) -> CustomerDossiers:
    """V5 for all users (or ``ids``) as flat, keyed sections."""
    ids = _keys(ids)
    from orderlens.operators.customers import addresses_ranked, customer_stats, recent_orders

    users = _only(t.users, "id", ids)
    stats = customer_stats(t.with_tables(users=users)).withColumnRenamed("user_id", "id")
    return CustomerDossiers(users=users.join(stats, "id", "left"),
                            addresses=_only(addresses_ranked(t), "user_id", ids),
                            recent_orders=recent_orders(t.with_tables(
                                orders=_only(t.orders, "user_id", ids),
                                orders_by_user=_only(t.user_orders, "user_id", ids))))
