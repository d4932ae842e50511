from __future__ import annotations

import os
import sys
import tempfile
from datetime import date, datetime
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from orderlens.sources.tables import SCHEMAS, Tables  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
AS_OF = datetime(2001, 7, 31, 12, 0, 0)


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("orderlens-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="orderlens-test-wh-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="orderlens-test-ckpt-"))
    yield s


def D(x):
    return None if x is None else Decimal(str(x))


def make_tables(spark, orders=(), items=(), users=(), addresses=(), payments=(), services=(), menu=(),
                updates=()) -> Tables:
    def df(name, rows):
        return spark.createDataFrame(list(rows), SCHEMAS[name])
    return Tables(orders=df("orders", orders), order_items=df("order_items", items), users=df("users", users),
                  addresses=df("addresses", addresses), payments=df("payments", payments),
                  services=df("services", services), menu=df("menu", menu),
                  status_updates=df("status_updates", updates))


def order(order_id, user_id=1, total=10, status="pending", when=datetime(2001, 7, 31, 9, 0), name="Alice",
          phone="900", email="a@x.com"):
    return (order_id, user_id, name, phone, email, D(total), "COD", "Pune", status, when, when)


def item(order_item_id, order_id, item_type="menu", item_id=1, name="Tea", qty=1, total=5, price=5):
    return (order_item_id, order_id, item_type, item_id, name, qty, D(total), D(price))


def user(uid, name="Alice", created=date(2001, 7, 31), active=True, city="Pune", state="MH"):
    return (uid, name, f"9{uid:09d}", f"u{uid}@x.com", city, state, active, created)
