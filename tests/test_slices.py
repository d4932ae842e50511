"""Order documents of tables above a slice: the same rows, with one slice's shuffle files at a time."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from orderlens.operators import dossiers
from orderlens.plans import positions, slices
from orderlens.sources.tables import SCHEMAS, Tables


def shop(spark, root: str) -> Tables:
    """Orders 0 to 59, one without id, one with 40 items and logs, some without any, two of one id; in files."""
    ids = [*range(60), 7, None]

    def table(name: str, rows: list[dict]):
        columns = SCHEMAS[name].fieldNames()
        made = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], ",".join(f"`{c}` string" for c in columns))
        made = made.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[name]])
        made.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    def text(**row):
        return {k: None if v is None else str(v) for k, v in row.items()}

    many = [k for i in ids for k in [i] * (40 if i == 31 else (i or 0) % 3)]
    return Tables(
        orders=table("orders", [text(order_id=i, user_id=(i or 0) % 9 or None, total_amount=5, status="pending", order_date=f"2001-01-{n % 28 + 1:02d} 00:00:00") for n, i in enumerate(ids)]),
        order_items=table("order_items", [text(order_item_id=n, order_id=i, item_type="menu" if n % 2 else "service", item_id=n % 5, quantity=1, total=n, price=2) for n, i in enumerate(many)]),
        users=table("users", [text(id=i, full_name=f"u{i}") for i in range(8)]),
        addresses=table("addresses", [text(id=i, user_id=i // 2, is_default=i % 2 == 0, city=f"c{i}") for i in range(12)]),
        payments=table("payments", [text(payment_id=n, order_id=i, amount=3, payment_status="completed") for n, i in enumerate(ids) if n % 4]),
        services=table("services", [text(id=i, name=f"s{i}") for i in range(4)]),
        menu=table("menu", [text(id=i, name=f"m{i}") for i in range(4)]),
        order_logs=table("order_logs", [text(log_id=n, order_id=i, action="note", new_status="pending", created_at="2001-02-01 00:00:00") for n, i in enumerate(many)]))


def test_documents_in_slices_equal_those_at_once(spark, tmp_path, monkeypatch):
    t = shop(spark, str(tmp_path))
    monkeypatch.setattr(positions, "HOT", 10)
    some = [*range(0, 60, 2)]
    table = spark.createDataFrame([(i,) for i in some], "order_id long")
    told = lambda docs: sorted(map(str, docs.collect()))
    whole, few = (told(dossiers.order_documents(t, ids, 3)) for ids in (None, table))

    kept = []
    monkeypatch.setattr(dossiers, "in_slices", lambda s, parts, made: kept.append(len(parts)) or slices.in_slices(s, parts, made))
    monkeypatch.setattr(slices, "SLICE_BYTES", -(-slices.file_bytes(t.orders, t.order_items, t.payments, t.order_logs) // 4))
    assert told(dossiers.order_documents(t, None, 3, t.order_logs)) == whole
    assert told(dossiers.order_documents(t, table, 3)) == few
    assert len(kept) == 2 and min(kept) > 1
    assert told(dossiers.order_documents(t, some, 3)) == few and len(kept) == 2  # a short list of ids is not cut


def test_a_slice_holds_all_rows_of_its_keys(spark, tmp_path, monkeypatch):
    t = shop(spark, str(tmp_path))
    monkeypatch.setattr(slices, "SLICE_BYTES", 500)
    parts = slices.slices([t.orders, t.order_items], "order_id")
    held = [[r[0] for r in t.orders.where(where).select("order_id").collect()] for where in parts]
    assert len(held) > 3 and sorted(map(str, sum(held, []))) == sorted(map(str, [*range(60), 7, None]))
    assert sum(7 in x for x in held) == 1
    assert len(slices.slices([t.users.select(F.col("full_name").alias("id"))], "id")) == 1


def test_what_a_step_materializes_goes_with_it(spark):
    from orderlens.plans.lineage import materialize_parquet, step

    with step(spark):
        inner = materialize_parquet(spark.range(5)).inputFiles()[0].removeprefix("file://")
        assert os.path.exists(inner)
    assert not os.path.exists(inner)
    kept = materialize_parquet(spark.range(5))
    assert kept.count() == 5
