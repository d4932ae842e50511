"""K1/K2 sink: status changes and audit rows stored per batch, committed last.

Parquet tables take no UPDATE, so the current status is not rewritten in
place.  Every applied batch writes only what it touched:

    {root}/status_delta/batch_id=N   (order_id, status, update_id, created_at)
    {root}/order_logs/batch_id=N     audit rows of the batch
    {root}/rejects/batch_id=N        updates naming no order
    {root}/_commits/batch_id=N       written LAST: the batch is visible

Writes are ``overwrite`` per batch folder, so replaying batch N (after a
lost executor or a restarted stream) replaces its own partial output and
nothing else.  Readers see committed batches only.  The current status of an
order is the base snapshot overridden by its newest committed delta, found
with a partial aggregate (``max(struct(batch_id, ...))``), so cost follows
the number of changes, not the size of ``orders``.

:func:`compact` folds the deltas up to a batch into a new base snapshot
(``_bases/batch_id=N``, committed by its own marker written last); readers
then start from the newest committed base and aggregate only later deltas,
so the override aggregate does not grow with the whole history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.operators.updates import StatusUpdateResult, current_status
from orderlens.sources.optional import read_parquet_if_present

SECTIONS = ("status_delta", "order_logs", "rejects")


def _path(root: str, section: str) -> str:
    return f"{root.rstrip('/')}/{section}"


def committed(spark: SparkSession, root: str, before: int | None = None,
              marker: str = "_commits") -> DataFrame | None:
    """Committed batch ids (optionally those below ``before``), or None."""
    markers = read_parquet_if_present(spark, _path(root, marker))
    if markers is None:  # no batch committed yet
        return None
    commits = markers.select("batch_id").distinct()
    if before is not None:
        commits = commits.where(F.col("batch_id") < before)
    return commits


def _read_section(spark: SparkSession, root: str, section: str, before: int | None = None,
                  after: int | None = None) -> DataFrame | None:
    commits = committed(spark, root, before)
    if commits is None:
        return None
    if after is not None:
        commits = commits.where(F.col("batch_id") > after)
    df = read_parquet_if_present(spark, _path(root, section))
    return None if df is None else df.join(commits, "batch_id", "left_semi")


def _latest_base(spark: SparkSession, root: str, before: int | None) -> int | None:
    """Newest committed compaction below ``before`` (one aggregated row)."""
    bases = committed(spark, root, before, marker="_base_commits")
    if bases is None:
        return None
    return bases.agg(F.max("batch_id")).first()[0]


def write_batch(spark: SparkSession, root: str, batch_id: int, result: StatusUpdateResult) -> None:
    for section, df in (("status_delta", result.changes), ("order_logs", result.logs),
                        ("rejects", result.rejects)):
        df.write.mode("overwrite").parquet(f"{_path(root, section)}/batch_id={batch_id}")
    marker = spark.range(1).select(F.lit(True).alias("committed"))
    marker.write.mode("overwrite").parquet(f"{_path(root, '_commits')}/batch_id={batch_id}")


def overrides(spark: SparkSession, root: str, before: int | None = None,
              after: int | None = None) -> DataFrame | None:
    """Newest committed status per changed order: ``(order_id, _new)``,
    over deltas with ``after < batch_id < before``."""
    delta = _read_section(spark, root, "status_delta", before, after)
    if delta is None:
        return None
    last = delta.groupBy("order_id").agg(F.max(F.struct("batch_id", "created_at", "update_id", "status")).alias("_l"))
    return last.select("order_id", F.col("_l.status").alias("_new"))


def current_orders(spark: SparkSession, base: DataFrame, root: str, before: int | None = None) -> DataFrame:
    """The orders with every committed change (below ``before``) applied:
    the newest compacted base if there is one, else ``base``, overridden by
    the later committed deltas."""
    compacted = _latest_base(spark, root, before)
    if compacted is not None:
        base = spark.read.parquet(f"{_path(root, '_bases')}/batch_id={compacted}")
    ov = overrides(spark, root, before, after=compacted)
    return base if ov is None else current_status(base, ov)


def compact(spark: SparkSession, base: DataFrame, root: str, upto: int) -> None:
    """Write the orders as of committed batch ``upto`` as a new base.

    A full rewrite of the orders table, meant to run rarely (e.g. daily);
    the marker is written last, so readers switch only to a complete base.
    """
    snapshot = current_orders(spark, base, root, before=upto + 1)
    snapshot.write.mode("overwrite").parquet(f"{_path(root, '_bases')}/batch_id={upto}")
    marker = spark.range(1).select(F.lit(True).alias("committed"))
    marker.write.mode("overwrite").parquet(f"{_path(root, '_base_commits')}/batch_id={upto}")


def read_logs(spark: SparkSession, root: str) -> DataFrame | None:
    logs = _read_section(spark, root, "order_logs")
    return None if logs is None else logs.drop("batch_id")


def read_rejects(spark: SparkSession, root: str) -> DataFrame | None:
    rej = _read_section(spark, root, "rejects")
    return None if rej is None else rej.drop("batch_id")
