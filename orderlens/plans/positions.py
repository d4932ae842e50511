"""A17, O6-O8 at scale: gapless positions within groups, and pages of them.

``row_number() OVER (PARTITION BY key ORDER BY ...)`` sorts a whole group in one
task.  Here rows are range-partitioned on (key, order...), so a hot key's rows
span many partitions in order; rows are numbered within (partition, key), and a
key that runs across a border of partitions gets what its earlier partitions
hold added.  Only a partition's first and last key can do so: that table has
two rows a partition and is broadcast, its size is the partition count.

Pages are of two kinds.  Keys with more than ``HOT`` rows go the way above.  All
others are small enough for a task: their rows are dealt by key once, numbered
and put into pages there.  ``HOT`` bounds the rows of a key in a task, and the
keys told apart are at most one for each ``HOT`` rows.

With positions, a group's page p holds exactly positions ``p * size`` up to
``(p + 1) * size - 1``, in order, whatever the tasks.  Which pages there are comes
from the parents and a count per key, one row a page; pages meet that list by
(key, page), so no task gets a whole hot group, and a parent without children has
one page that is empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.plans.lineage import materialize, materialize_parquet
from orderlens.session import ensure_checkpoint_dir

#: Rows of a key that one task numbers and nests at most.
HOT = 1000
#: Hot keys that are broadcast; more of them are joined by key.
BROADCAST_KEYS = 500_000


def _ranged(df: DataFrame, key: str, order: Sequence[Column], num_partitions: int | None) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return materialize_parquet(df.where(F.col(key).isNotNull()).repartitionByRange(n, F.col(key), *order)
                               .withColumn("_pid", F.spark_partition_id()))


def _numbered(ranged: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    ends = ranged.groupBy("_pid").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    border = ranged.select("_pid", key).join(F.broadcast(ends), "_pid").where((F.col(key) == F.col("_lo")) | (F.col(key) == F.col("_hi")))
    earlier = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    held = (border.groupBy("_pid", key).agg(F.count(F.lit(1)).alias("_n"))
            .select("_pid", key, F.sum("_n").over(earlier).alias("_before")).where("_before > 0"))
    own = F.row_number().over(Window.partitionBy("_pid", key).orderBy(*order)) - 1
    return (ranged.withColumn("_own", own).join(F.broadcast(held), ["_pid", key], "left")
            .withColumn("position", (F.col("_own") + F.coalesce("_before", F.lit(0))).cast("long"))
            .drop("_pid", "_own", "_before"))


def with_positions(df: DataFrame, key: str, order: Sequence[Column], num_partitions: int | None = None) -> DataFrame:
    """``df`` without rows of a NULL key, with ``position``: 0, 1, ... within
    each key in the given order (which must tell a key's rows apart)."""
    return _numbered(_ranged(df, key, order, num_partitions), key, order)


def _listed(position: Column, payload: Sequence[str], alias: str) -> Column:
    return F.sort_array(F.collect_list(F.struct(position.alias("position"), *payload))).alias(alias)


def _hot_pages(children: DataFrame, parents: DataFrame, key: str, order: Sequence[Column], size: int, alias: str,
               num_partitions: int | None) -> DataFrame:
    """Pages of keys that are too large for a task; NULL where a parent has no children."""
    ranged = _ranged(children, key, order, num_partitions)
    payload = [c for c in children.columns if c != key]
    pages = (_numbered(ranged, key, order).withColumn("part", F.floor(F.col("position") / F.lit(size)).cast("long"))
             .repartition(key, "part").groupBy(key, "part").agg(_listed(F.col("position"), payload, alias)))
    counts = ranged.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.greatest(F.ceil(F.coalesce(F.col("_n"), F.lit(0)) / F.lit(size)), F.lit(1)).cast("long")
    listed = (parents.select(key).join(counts, key, "left").select(key, parts.alias("parts"))
              .select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "parts")
              .repartition(key, "part"))  # left by the join dealt by key alone, which would do for the join below
    return listed.join(pages, [key, "part"], "left").select(key, "part", "parts", alias)


def _small_pages(children: DataFrame, parents: DataFrame, key: str, order: Sequence[Column], size: int, alias: str) -> DataFrame:
    """Pages of keys that a task holds; NULL where a parent has no children."""
    payload = [c for c in children.columns if c != key]
    own = Window.partitionBy(key)
    numbered = (children.where(F.col(key).isNotNull())
                .withColumn("position", (F.row_number().over(own.orderBy(*order)) - 1).cast("long"))
                .withColumn("_n", F.count(F.lit(1)).over(own)))
    pages = (numbered.groupBy(key, F.floor(F.col("position") / F.lit(size)).cast("long").alias("part"))
             .agg(F.max(F.ceil(F.col("_n") / F.lit(size)).cast("long")).alias("parts"), _listed(F.col("position"), payload, alias)))
    # every part of a key has rows, so a join by key, as the rows are dealt already, gives them all
    return parents.select(key).join(pages, key, "left").select(
        key, F.coalesce("part", F.lit(0).cast("long")).alias("part"), F.coalesce("parts", F.lit(1).cast("long")).alias("parts"), alias)


def nest_pages(children: DataFrame, parents: DataFrame, key: str, order: Sequence[Column], size: int, alias: str,
               num_partitions: int | None = None, weigh: DataFrame | None = None) -> DataFrame:
    """Rows ``(key, part, parts, <alias>: array<struct<position, ...>>)`` for
    every key of ``parents`` (distinct keys): its children in pages of ``size``,
    one empty page where it has none.  ``weigh`` has about as many rows of a key
    as ``children`` has, and is cheaper to count."""
    if size < 1:
        raise ValueError("size must be >= 1")
    rows = children if weigh is None else weigh
    hot = materialize(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT).select(key))
    n = hot.count()
    if n == 0:
        pages = _small_pages(children, parents, key, order, size, alias)
    else:
        hot = F.broadcast(hot) if n <= BROADCAST_KEYS else hot
        small = _small_pages(children.join(hot, key, "left_anti"), parents.join(hot, key, "left_anti"), key, order, size, alias)
        large = _hot_pages(children.join(hot, key, "left_semi"), parents.join(hot, key, "left_semi"), key, order, size, alias, num_partitions)
        pages = small.unionByName(large)
    payload = [c for c in children.columns if c != key]
    empty = F.slice(F.array(F.struct(F.lit(0).cast("long").alias("position"), *[F.lit(None).cast(children.schema[c].dataType).alias(c) for c in payload])), 1, 0)
    return pages.select(key, "part", "parts", F.coalesce(alias, empty).alias(alias))
