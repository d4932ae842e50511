"""Apply status changes to orders and produce the audit log.

The reference applies one change at a time: read the old status, update the
order, insert a log row, commit.  In bulk, with updates applied in
``(created_at, update_id)`` order per order:

* unknown orders are rejected (anti join) with reason "Order not found";
* each applied update's ``old_status`` is the previous update's new status,
  or the order's status before the batch for the first one (W4);
* the last update wins in the snapshot (W5), found with a partially
  aggregated ``max(struct(created_at, update_id, new_status))``.

No transition rules; an update to the same status is applied and logged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.plans.joins import restrict_to_key_range
from orderlens.plans.lineage import materialize
from orderlens.plans.sequence import with_previous

# The action written to the log and the reject reason.
ACTION = "status_update"
NOT_FOUND = "Order not found"

UPDATE_ORDER = ["created_at", "update_id"]


@dataclass(frozen=True)
class StatusUpdateResult:
    snapshot: DataFrame   # all orders, status after the batch
    changes: DataFrame    # (order_id, status, update_id, created_at): touched orders only
    logs: DataFrame       # one order_logs row per applied update
    rejects: DataFrame    # updates naming no order, with a reason


def last_updates(updates: DataFrame) -> DataFrame:
    """The winning update per order."""
    last = updates.groupBy("order_id").agg(F.max(F.struct(*UPDATE_ORDER, "new_status")).alias("_last"))
    return last.select("order_id", F.col("_last.new_status").alias("status"),
                       F.col("_last.update_id").alias("update_id"), F.col("_last.created_at").alias("created_at"))


def apply_status_updates(orders: DataFrame, updates: DataFrame,
                         num_partitions: int | None = None) -> StatusUpdateResult:
    """Apply ``updates`` to ``orders``.

    Only orders named by the batch are touched: ``orders`` is semi-joined with
    the batch's distinct keys (the small side, which AQE broadcasts when a
    micro-batch is small, so the orders table is scanned but not shuffled),
    and that touched set is checkpointed once for the three uses below.
    """
    batch_keys = updates.select("order_id").distinct()
    # the batch's id range is pushed into the orders scan (a superset filter:
    # recent orders have recent ids, so a micro-batch reads a narrow slice)
    current = restrict_to_key_range(orders.select("order_id", F.col("status").alias("_current")),
                                    batch_keys, "order_id")
    touched = materialize(current.join(batch_keys, "order_id", "left_semi"))
    keys = touched.select("order_id")
    valid = updates.join(keys, "order_id", "left_semi")
    rejects = (updates.join(keys, "order_id", "left_anti")
               .withColumn("reason", F.lit(NOT_FOUND)))

    # Only the first update of each order needs the order's current status.  The others carry their own id as
    # join key, which meets nothing: one pass over the sequence, and a hot order adds no skew.
    seq = (with_previous(valid, "order_id", UPDATE_ORDER, "new_status", num_partitions)
           .withColumn("_first", ~F.col("has_prev"))
           .withColumn("_key", F.when(F.col("_first"), F.col("order_id")).otherwise(F.col("update_id"))))
    before = touched.select(F.col("order_id").alias("_key"), F.lit(True).alias("_first"), "_current")
    both = seq.join(before, ["_key", "_first"], "left")
    old = F.when(F.col("has_prev"), F.col("prev_new_status")).otherwise(F.col("_current"))
    logs = both.select(
        F.col("update_id").alias("log_id"),
        "order_id",
        "admin_id",
        F.lit(ACTION).alias("action"),
        F.col("notes").alias("details"),
        old.alias("old_status"),
        "new_status",
        "created_at",
    )

    # reduced before the join: a hot order is one row per map task when it is shuffled
    changes = last_updates(updates).join(keys, "order_id", "left_semi")
    snapshot = current_status(orders, changes.select("order_id", F.col("status").alias("_new")))
    return StatusUpdateResult(snapshot=snapshot, changes=changes, logs=logs, rejects=rejects)


def current_status(orders: DataFrame, overrides: DataFrame) -> DataFrame:
    """K2: orders with ``status`` replaced where an override ``(order_id,
    _new)`` exists (one row per order in ``overrides``)."""
    cols = [F.when(F.col("_o.order_id").isNotNull(), F.col("_o._new")).otherwise(F.col("_b.status")).alias("status")
            if c == "status" else F.col(f"_b.{c}") for c in orders.columns]
    return (orders.alias("_b").join(overrides.alias("_o"), F.col("_b.order_id") == F.col("_o.order_id"), "left")
            .select(*cols))
