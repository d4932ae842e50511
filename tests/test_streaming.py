"""Stream jobs over several micro-batches."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from orderlens.operators import stats
from orderlens.sources.fixtures import shop_tables
from orderlens.streaming import live


def test_live_timeline_over_several_batches_equals_batch(spark, tmp_path):
    """Orders arrive in three files, in time order, with one hour split across
    the first two; each file is one micro-batch.  Both batches write a part
    of the split hour and the parts add up to the batch timeline."""
    t = shop_tables(spark, SF_SMALL)
    orders = t.orders.where(F.col("order_date").isNotNull())
    # an hour holding two or more orders: cut between its first and last one
    hour = (orders.groupBy(stats.bucket("order_date", "hour").alias("h"))
            .agg(F.min("order_date").alias("lo"), F.max("order_date").alias("hi"))
            .where(F.col("lo") < F.col("hi")).orderBy("h").first())
    assert hour is not None
    cut1 = F.lit(hour["hi"].isoformat(sep=" ")).cast("timestamp_ntz")
    cut2 = F.lit("2000-06-01 00:00:00").cast("timestamp_ntz")
    src = tmp_path / "orders_in"
    parts = [orders.where(F.col("order_date") < cut1),
             orders.where((F.col("order_date") >= cut1) & (F.col("order_date") < cut2)),
             orders.where(F.col("order_date") >= cut2)]
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(src / f"batch{i}"))
    stream = (spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(str(src)))
    root = str(tmp_path / "st1")
    got = live.live_timeline(spark, stream, root=root)
    out = spark.read.parquet(f"{root}/out/parts")
    assert out.select("level", "seq").distinct().count() >= 3
    split = out.where(F.col("period") == F.lit(hour["h"].isoformat(sep=" ")).cast("timestamp_ntz"))
    assert split.select("level", "seq").distinct().count() == 2  # the split hour was updated twice
    want = (orders.groupBy(stats.bucket("order_date", "hour").alias("period"))
            .agg(F.count(F.lit(1)).alias("order_count"),
                 F.coalesce(F.sum("total_amount").cast("double"), F.lit(0.0)).alias("total_revenue")))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_status_update_stream_over_several_batches_equals_batch(spark, tmp_path):
    """Updates arrive in three time-ordered files (three micro-batches); each
    batch starts from the statuses committed by the earlier ones, so the log
    and the final statuses equal one batch application of all updates."""
    from orderlens.operators import updates
    from orderlens.sources import status_store

    t = shop_tables(spark, SF_SMALL)
    ups = t.status_updates
    q1, q2 = ups.selectExpr("percentile_approx(created_at, array(0.33, 0.66))").first()[0]
    src = tmp_path / "updates_in"
    parts = [ups.where(F.col("created_at") <= F.lit(q1)),
             ups.where((F.col("created_at") > F.lit(q1)) & (F.col("created_at") <= F.lit(q2))),
             ups.where(F.col("created_at") > F.lit(q2))]
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(src / f"batch{i}"))
    stream = (spark.readStream.schema(ups.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(str(src)))
    root = str(tmp_path / "st2")
    logs = live.stream_status_updates(stream, t.orders, root=root)
    assert status_store.committed(spark, root).count() == 3
    whole = updates.apply_status_updates(t.orders, ups)
    assert logs.exceptAll(whole.logs).count() == 0 and whole.logs.exceptAll(logs).count() == 0
    final = status_store.current_orders(spark, t.orders, root)
    assert final.exceptAll(whole.snapshot).count() == 0


def test_live_timeline_loses_nothing_when_orders_come_in_any_order(spark, tmp_path):
    """Four files dealt by order id, so that every micro-batch spans the whole time."""
    orders = shop_tables(spark, SF_SMALL).orders.where(F.col("order_date").isNotNull())
    src = tmp_path / "orders_in"
    for i in (2, 0, 3, 1):
        orders.where(F.col("order_id") % 4 == i).coalesce(1).write.parquet(str(src / f"batch{i}"))
    stream = (spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(str(src)))
    root = str(tmp_path / "st1")
    got = live.live_timeline(spark, stream, root=root)
    assert len(live.timeline_store(spark, f"{root}/out").visible()) == 4
    want = (orders.groupBy(stats.bucket("order_date", "hour").alias("period"))
            .agg(F.count(F.lit(1)).alias("order_count"),
                 F.coalesce(F.sum("total_amount").cast("double"), F.lit(0.0)).alias("total_revenue")))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_a_damaged_commit_marker_is_an_error_not_an_empty_store(spark, tmp_path):
    import pytest

    from orderlens.sources import status_store

    root = tmp_path / "store"
    assert status_store.committed(spark, str(root)) is None
    marker = root / "_commits" / "batch_id=0"
    marker.mkdir(parents=True)
    (marker / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        status_store.committed(spark, str(root)).count()


def test_an_empty_stream_gives_empty_tables(spark, tmp_path):
    t = shop_tables(spark, SF_SMALL)
    (tmp_path / "in").mkdir()
    for schema, run in ((t.orders.schema, lambda s: live.live_timeline(spark, s, root=str(tmp_path / "st1"))),
                        (t.status_updates.schema, lambda s: live.stream_status_updates(s, t.orders, root=str(tmp_path / "st2")))):
        got = run(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        assert got.count() == 0 and got.columns


def test_a_batch_that_is_not_committed_is_not_read(spark, tmp_path):
    import shutil

    store = live.timeline_store(spark, str(tmp_path / "out"))
    sums = live.partial_timeline(shop_tables(spark, SF_SMALL).orders)
    store.write(0, sums)
    store.write(1, sums)
    once = store.read().agg(F.sum("order_count")).first()[0]
    shutil.rmtree(tmp_path / "out" / "_commits" / "level=0" / "seq=1", ignore_errors=True)
    (tmp_path / "out" / "_commits" / "level=0" / "seq=1").unlink(missing_ok=True)
    assert store.read().agg(F.sum("order_count")).first()[0] * 2 == once
    store.write(1, sums)  # the replay
    assert store.read().agg(F.sum("order_count")).first()[0] == once
