"""Both branches of the bounded join helpers."""

import pytest
from pyspark.sql import functions as F

from orderlens.plans.joins import restrict_to_key_range, restrict_to_keys
from orderlens.plans.paging import MAX_PER_PAGE, check_page, keyset_page


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_restrict_to_keys_in_list_and_fallback(spark):
    child = spark.range(100).withColumnRenamed("id", "k")
    keys = spark.range(5).withColumnRenamed("id", "k")
    small = restrict_to_keys(child, keys, "k", max_keys=10)
    assert sorted(r.k for r in small.collect()) == [0, 1, 2, 3, 4]
    assert "In(" in _plan(small) or "IN (" in _plan(small).upper()
    big = restrict_to_keys(child, keys, "k", max_keys=3)   # over the bound: semi join, nothing collected
    assert sorted(r.k for r in big.collect()) == [0, 1, 2, 3, 4]
    assert "LeftSemi" in _plan(big)
    none = restrict_to_keys(child, keys.where("k < 0"), "k", max_keys=10)
    assert none.count() == 0


def test_restrict_to_key_range_is_a_superset(spark):
    child = spark.range(100).withColumnRenamed("id", "k")
    keys = spark.createDataFrame([(10,), (20,), (15,)], "k long")
    got = restrict_to_key_range(child, keys, "k")
    assert got.agg(F.min("k"), F.max("k"), F.count("*")).first() == (10, 20, 11)
    assert restrict_to_key_range(child, keys.where("k < 0"), "k").count() == 0


def test_page_size_is_bounded(spark):
    for size in (0, MAX_PER_PAGE + 1):
        with pytest.raises(ValueError):
            check_page(1, size)
        with pytest.raises(ValueError):
            keyset_page(spark.range(3), "id", "id", size)
    assert check_page(3, MAX_PER_PAGE) == 2 * MAX_PER_PAGE
