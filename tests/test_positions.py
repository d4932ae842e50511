"""Positions and pages within groups, hot groups and empty ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from orderlens.plans.positions import nest_pages, with_positions


def rows(n, seed=3):
    rnd = random.Random(seed)
    return [(rnd.choice([1, 1, 1, 2, 3, 9, None]), rnd.choice([None, 1, 2, 3]), i) for i in range(n)]


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_positions_are_gapless_in_order(spark, partitions):
    data = rows(400)
    df = spark.createDataFrame(data, "k long, at int, id long").repartition(5)
    got = {(r.k, r.id): r.position for r in with_positions(df, "k", [F.desc_nulls_first("at"), F.desc("id")], partitions).collect()}
    want = {}
    for key in {k for k, _, _ in data if k is not None}:
        mine = sorted((r for r in data if r[0] == key), key=lambda r: (r[1] is not None, -(r[1] or 0), -r[2]))
        want.update({(key, r[2]): i for i, r in enumerate(mine)})
    assert got == want


def test_pages_hold_their_positions_and_parents_without_children_have_an_empty_one(spark):
    df = spark.createDataFrame(rows(300), "k long, at int, id long").repartition(4)
    parents = spark.createDataFrame([(1,), (2,), (3,), (9,), (50,)], "k long")
    pages = nest_pages(df, parents, "k", [F.col("id").asc()], 7, "list", 8).collect()
    counts = {r["k"]: r["n"] for r in df.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    for p in pages:
        n = counts.get(p.k, 0)
        assert p.parts == max(1, -(-n // 7)) and 0 <= p.part < p.parts
        assert [e.position for e in p.list] == list(range(p.part * 7, min(n, (p.part + 1) * 7)))
    assert sum(len(p.list) for p in pages) == sum(counts.values())
    assert [(p.part, p.parts, p.list) for p in pages if p.k == 50] == [(0, 1, [])]
    assert len({(p.k, p.part) for p in pages}) == len(pages)
    assert all([e.id for e in p.list] == sorted(e.id for e in p.list) for p in pages)


def test_a_hot_group_spans_tasks(spark):
    df = spark.range(4000).select(F.lit(1).cast("long").alias("k"), F.col("id"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # as with large tables
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        pages = nest_pages(df, spark.createDataFrame([(1,)], "k long"), "k", [F.col("id").asc()], 10, "list", 8)
        per_task = pages.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(per_task) >= 4 and max(r["n"] for r in per_task) <= 200


def test_bad_size(spark):
    with pytest.raises(ValueError):
        nest_pages(spark.range(1).withColumnRenamed("id", "k"), spark.range(1).withColumnRenamed("id", "k"), "k", [], 0, "list")


def test_keys_of_a_task_are_shuffled_once_and_not_written(spark, monkeypatch):
    from orderlens.plans import positions

    monkeypatch.setattr(positions, "_ranged", None)  # the way of hot keys
    df = spark.createDataFrame(rows(300), "k long, at int, id long").repartition(4)
    parents = spark.createDataFrame([(1,), (2,), (50,), (None,)], "k long")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = nest_pages(df, parents, "k", [F.col("id").asc()], 7, "list")
        assert len(pages.collect()) > 4
        plan = pages._jdf.queryExecution().optimizedPlan().toString()
        final = pages._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Window" in plan and final.count("Exchange hashpartitioning") == 2  # children and parents, once each


@pytest.mark.parametrize("hot", [0, 30, 10_000])
def test_hot_and_small_keys_have_the_same_pages(spark, monkeypatch, hot):
    from orderlens.plans import positions

    monkeypatch.setattr(positions, "HOT", hot)
    data = rows(300)
    df = spark.createDataFrame(data, "k long, at int, id long").repartition(4)
    parents = spark.createDataFrame([(1,), (2,), (3,), (50,), (None,)], "k long")
    got = sorted((r.k or -1, r.part, r.parts, [(e.position, e.id) for e in r.list]) for r in
                 nest_pages(df, parents, "k", [F.col("id").asc()], 7, "list", 8).collect())
    want = []
    for key in (1, 2, 3, 50, None):
        ids = sorted(i for k, _, i in data if k == key and key is not None)
        parts = max(1, -(-len(ids) // 7))
        want += [(key or -1, p, parts, list(enumerate(ids))[p * 7:p * 7 + 7]) for p in range(parts)]
    assert got == sorted(want)
