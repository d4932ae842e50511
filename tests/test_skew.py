"""Hot keys: one key holding a large share of rows must give exact results
while spreading over several tasks."""

from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from orderlens.operators.updates import apply_status_updates
from orderlens.plans.joins import pick_one
from orderlens.plans.nesting import nest_chunks
from orderlens.plans.sequence import with_previous


def _updates(spark, n_hot=3000, n_cold=300):
    base = datetime(2024, 1, 1)
    rows = [(i, 7, f"s{i % 5}", base + timedelta(seconds=i // 2)) for i in range(n_hot)]
    rows += [(n_hot + i, 100 + i % 50, f"s{i % 3}", base + timedelta(seconds=i)) for i in range(n_cold)]
    return spark.createDataFrame(rows, "update_id long, order_id long, new_status string, created_at timestamp_ntz")


def test_previous_matches_window_lag_with_hot_key(spark):
    df = _updates(spark)
    got = with_previous(df, "order_id", ["created_at", "update_id"], "new_status", num_partitions=8)
    w = Window.partitionBy("order_id").orderBy("created_at", "update_id")
    want = df.withColumn("prev_new_status", F.lag("new_status").over(w)) \
             .withColumn("has_prev", F.row_number().over(w) > 1)
    cols = ["update_id", "has_prev", "prev_new_status"]
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0
    assert got.count() == df.count()


def test_hot_key_spans_several_range_partitions(spark):
    df = _updates(spark)
    ranged = df.repartitionByRange(8, "order_id", "created_at", "update_id")
    parts = ranged.where("order_id = 7").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1


def test_nest_chunks_keeps_every_child_and_bounds_chunks(spark):
    df = _updates(spark)
    chunks = nest_chunks(df, "order_id", ["created_at", "update_id"], ["new_status"], chunk_size=100)
    sizes = chunks.select("order_id", "part", F.size("children").alias("n"))
    assert sizes.agg(F.sum("n")).first()[0] == df.count()
    hot = sizes.where("order_id = 7")
    assert hot.count() == 30 and hot.agg(F.max("n")).first()[0] < 200
    inner = chunks.where("order_id = 7").select(F.explode("children").alias("c")).select("c.update_id")
    assert inner.distinct().count() == 3000


def test_pick_one_is_partial_aggregate(spark):
    df = _updates(spark)
    picked = pick_one(df, "order_id", ["update_id"], "first")
    assert picked.where("order_id = 7").first()["first"]["update_id"] == 0
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan or "Partial" in plan


def test_hot_key_of_nested_chunks_and_last_updates_spans_tasks(spark):
    df = _updates(spark)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        chunks = nest_chunks(df, "order_id", ["created_at", "update_id"], ["new_status"], chunk_size=100)
        tasks = chunks.where("order_id = 7").select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 1
        orders = spark.createDataFrame([(7, "new")] + [(100 + i, "new") for i in range(40)], "order_id long, status string")
        changes = apply_status_updates(orders, df.withColumn("admin_id", F.lit(1)).withColumn("notes", F.lit("")),
                                       num_partitions=4).changes
        plan = changes._jdf.queryExecution().executedPlan().toString()
        # the partial aggregate runs on the unshuffled updates, below the semi join
        assert plan.index("LeftSemi") < plan.index("partial_max")
        assert "Exchange" in plan[plan.index("LeftSemi"):plan.index("partial_max")]
        assert changes.count() == 41 and changes.where("order_id = 7").first()["update_id"] == 2999
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
