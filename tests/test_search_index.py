"""The trigram index against a search of the whole table."""

from __future__ import annotations

import random

import pytest

from conftest import SF_SMALL
from orderlens.functions.predicates import search_any
from orderlens.sources import search_index
from orderlens.sources.fixtures import shop_tables
from orderlens.sources.search_index import SearchIndex, order_index
from pyspark.sql import functions as F

NAMES = ["Alice", "ALICE B.", "alicia", "Ali%ce", "a_b_c_d", "back\\slash", "Größe Öl", "GRÖSSE", "日本語の名前", "ΟΔΟΣ", "İstanbul", "KKelvin",
         "", "ab", None, "aaa aaa aaaa", "x" * 50]
TERMS = ["ali", "ALICE", "lice", "a%e", "ali%ce", "a_i", "al_ce", "ab", "", None, "%", "___", "back\\sl", "\\", "größe", "ÖL", "本語の", "δος", "ΟΔΟΣ", "İst",
         "kel", "aaa", "aaaaa", "zzz", "12", "123", "1%3", "9@e", "xxx", "ali%zzz", "e B."]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rnd = random.Random(2)
    rows = [(i * 7, rnd.choice(NAMES), rnd.choice([f"{i}@ex.com", None])) for i in range(400)] + [(100_000 + i, "far Alice", None) for i in range(3)]
    root = tmp_path_factory.mktemp("index")
    df = spark.createDataFrame(rows, "id long, name string, mail string")
    df.repartitionByRange(6, "id").sortWithinPartitions("id").write.parquet(str(root / "table"))
    df = spark.read.parquet(str(root / "table"))
    index = SearchIndex(spark, str(root / "index"), "id", ("name", "mail", "id"))
    index.add(df.where("id % 2 = 0"), 0)
    index.add(df.where("id % 2 = 1"), 1)
    index.add(df.where("id % 2 = 1"), 1)  # a replay
    return df, index


@pytest.mark.parametrize("term", TERMS)
def test_search_equals_the_scan(table, term):
    df, index = table
    pred = search_any(term, [F.col("name"), F.col("mail"), F.col("id").cast("string")])
    want = {r.id for r in (df if pred is None else df.where(pred)).collect()}
    got = [r.id for r in index.search(df, term).collect()]
    assert set(got) == want and len(got) == len(want)


def test_many_candidates_go_as_ranges(table, monkeypatch):
    df, index = table
    want = {r.id for r in df.where(F.col("name").ilike("%ali%")).collect()}
    monkeypatch.setattr(search_index, "KEYS", 5)
    for ranges in (1, 3, 1000):
        monkeypatch.setattr(search_index, "RANGES", ranges)
        assert {r.id for r in index.search(df, "ali").collect()} == want


def test_blocks_are_bounded(table, monkeypatch, spark, tmp_path):
    df, _ = table
    monkeypatch.setattr(search_index, "BLOCK", 16)
    index = SearchIndex(spark, str(tmp_path), "id", ("name",))
    index.add(df)
    assert index.postings().agg(F.max(F.size("ids"))).first()[0] <= 16
    assert {r.id for r in index.search(df, "alice").collect()} == {r.id for r in df.where(F.col("name").ilike("%alice%")).collect()}


def scanned(df):
    """Rows that the scans of a plan gave out."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())
               if leaves.apply(i).metrics().contains("numOutputRows"))


def test_only_row_groups_with_candidates_are_read(table, spark):
    df, index = table
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hit = index.search(df, "far alice")
        plan = hit._jdf.queryExecution().executedPlan().toString()
        assert "In(id, [100000,100001,100002])" in plan
        assert scanned(hit) < df.count() / 3 and scanned(index.search(df, "zz")) == df.count()  # no gram: the whole table
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_a_batch_without_marker_is_not_searched(spark, tmp_path):
    import shutil

    df = shop_tables(spark, SF_SMALL).orders
    index = order_index(spark, str(tmp_path))
    assert index.candidates("customer") is None and index.search(df, "customer").count() == df.where(F.col("user_name").ilike("%customer%")).count()
    index.add(df.where("order_id % 2 = 0"), 0)
    index.add(df.where("order_id % 2 = 1"), 1)
    shutil.rmtree(tmp_path / "_commits" / "batch_id=1")
    assert index.candidates("customer").where("order_id % 2 = 1").count() == 0
    assert index.candidates("customer").count() == df.where("order_id % 2 = 0").count()


def test_rows_are_dealt_by_block_and_postings_tell_keys_by_bits(spark, tmp_path):
    df = spark.range(-200, 9000).select("id", F.lit("same name").alias("name"))
    index = SearchIndex(spark, str(tmp_path), "id", ("name",))
    index.add(df)
    stored = index.postings()
    # a number for 64 keys, not one for a key
    assert stored.agg(F.max(F.size("ids"))).first()[0] <= search_index.BLOCK // search_index.WORD
    assert sorted(r.id for r in index.candidates("same na").collect()) == list(range(-200, 9000))
