"""The tiered store of partial sums: commits, merges, replays and what a reader sees."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import types as T

from orderlens.sources.tiered_store import TieredStore

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType()), T.StructField("m", T.DecimalType(20, 2))])


def make(spark, path, fanout=3):
    return TieredStore(spark, str(path), SCHEMA, ("k",), fanout)


def batch(spark, i):
    from decimal import Decimal

    rnd = random.Random(i)
    return [(rnd.choice(["a", "b", None]), rnd.randint(-5, 5), Decimal(rnd.randint(0, 500)) / 100) for _ in range(4)]


def total(rows):
    out = {}
    for k, n, m in rows:
        a, b = out.get(k, (0, 0))
        out[k] = (a + n, b + m)
    return out


def read(store):
    return {r.k: (r.n, r.m) for r in store.read().collect()}


def test_reads_add_up_all_batches_and_parts_stay_logarithmic(spark, tmp_path):
    store = make(spark, tmp_path)
    assert store.read().count() == 0 and store.read().columns == ["k", "n", "m"]
    rows = []
    for i in range(14):
        rows += batch(spark, i)
        store.write(i, spark.createDataFrame(batch(spark, i), SCHEMA))
        assert len(store.visible()) <= 2 * 3
        folders = [d for lv in os.listdir(tmp_path / "parts") for d in os.listdir(tmp_path / "parts" / lv)]
        assert len(folders) <= 12  # the visible ones and the last merge's children
        if i in (0, 2, 3, 8, 13):
            assert read(store) == total(rows)
    assert store.visible() == [(0, 12), (0, 13), (1, 3), (2, 0)]


def test_replays_change_nothing(spark, tmp_path):
    store = make(spark, tmp_path)
    for i in (0, 1, 2, 2, 0, 3, 3, 1):
        store.write(i, spark.createDataFrame(batch(spark, i), SCHEMA))
    assert read(store) == total([r for i in range(4) for r in batch(spark, i)])


@pytest.mark.parametrize("section", ["_commits", "parts"])
def test_a_merge_that_broke_off_is_done_by_the_replay(spark, tmp_path, monkeypatch, section):
    store = make(spark, tmp_path)
    store.write(0, spark.createDataFrame(batch(spark, 0), SCHEMA))
    store.write(1, spark.createDataFrame(batch(spark, 1), SCHEMA))
    plain = TieredStore._commit if section == "_commits" else TieredStore._write

    def breaks(self, *args):
        level = args[0] if section == "_commits" else args[1]
        if level == 1:
            raise RuntimeError("driver lost")
        return plain(self, *args)

    monkeypatch.setattr(TieredStore, "_commit" if section == "_commits" else "_write", breaks)
    with pytest.raises(RuntimeError):
        store.write(2, spark.createDataFrame(batch(spark, 2), SCHEMA))
    want = total([r for i in range(3) for r in batch(spark, i)])
    assert read(store) == want  # the three batches themselves
    monkeypatch.undo()
    store.write(2, spark.createDataFrame(batch(spark, 2), SCHEMA))
    assert read(store) == want and store.visible() == [(1, 0)]


def test_a_reader_from_before_a_merge_still_finds_its_files(spark, tmp_path):
    store = make(spark, tmp_path)
    for i in range(2):
        store.write(i, spark.createDataFrame(batch(spark, i), SCHEMA))
    before = store.read()
    store.write(2, spark.createDataFrame(batch(spark, 2), SCHEMA))
    assert {r.k: (r.n, r.m) for r in before.collect()} == total([r for i in range(2) for r in batch(spark, i)])


def test_bad_arguments(spark, tmp_path):
    with pytest.raises(ValueError):
        make(spark, tmp_path, fanout=1)
    with pytest.raises(ValueError):
        make(spark, tmp_path).write(-1, spark.createDataFrame([], SCHEMA))
