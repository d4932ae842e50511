"""Previous value within an ordered group, without a whole group in one task.

``lag(v) OVER (PARTITION BY key ORDER BY ...)`` sorts every key's rows in a
single task, so a key holding a third of the table is a third of the table in
one task.  Here rows are range-partitioned on ``(key, order...)`` instead:
Spark samples the full sort key, so a hot key spreads over many partitions
in sort order.  Within a partition the window runs over (partition, key)
groups, which are bounded by the partition size.  The first row of each such
group takes its predecessor from the last row of the previous non-empty
partition (a "carry" table with one row per partition, broadcast: its size
is the partition count, not the data).

The partition ids are materialized with a reliable ``checkpoint()`` (written
to the session's ``spark.checkpoint.dir``), so a lost executor recomputes
nothing inconsistently and the lineage is cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.session import ensure_checkpoint_dir


def with_previous(df: DataFrame, key: str, order: Sequence[str], value: str,
                  num_partitions: int | None = None) -> DataFrame:
    """Add ``has_prev`` (bool) and ``prev_<value>`` for every row: the value of
    the row just before it among rows of the same ``key`` ordered by
    ``order`` (ascending, NULLs first; ``order`` must make rows unique)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_cols = [key, *order]
    ranged = (df.repartitionByRange(n, *[F.asc_nulls_first(c) for c in sort_cols])
              .withColumn("_pid", F.spark_partition_id())
              .checkpoint(eager=True))

    w = Window.partitionBy("_pid", key).orderBy(*[F.asc_nulls_first(c) for c in order])
    local = (ranged.withColumn("_lag", F.lag(value).over(w))
             .withColumn("_first", F.row_number().over(w) == 1))

    last = ranged.groupBy("_pid").agg(F.max(F.struct(*sort_cols, value)).alias("_last"))
    carry = (last.withColumn("_carry", F.lag("_last").over(Window.orderBy("_pid")))
             .select("_pid", "_carry"))

    out = local.join(F.broadcast(carry), "_pid", "left")
    carried = F.col("_first") & F.col("_carry").isNotNull() & (F.col("_carry")[key] == F.col(key))
    prev = F.when(~F.col("_first"), F.col("_lag")).when(carried, F.col("_carry")[value])
    return (out.withColumn("has_prev", (~F.col("_first")) | carried)
            .withColumn(f"prev_{value}", prev)
            .drop("_pid", "_lag", "_first", "_carry"))
