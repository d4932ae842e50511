"""A17 at scale: nested child arrays in bounded chunks.

``collect_list`` over every child of a key puts the whole group into one row
(one task, one executor's memory).  Here children are first counted per key
(a partial aggregate), then each key's children are spread over
``ceil(n / chunk_size)`` parts by a hash of the child's sort key, dealt out by
(key, part), and each (key, part) is collected and sorted.  The exchange is
explicit: the join with the counts leaves rows partitioned by key alone, which
would satisfy the grouping and keep a hot key in one task.  A key with a third
of all rows becomes many bounded rows in many tasks; a normal key stays one row.  Nothing is dropped: the
union of a key's parts is exactly its children, and every element carries its
sort key so a reader can merge parts back into order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nest_chunks(children: DataFrame, key: str, sort_cols: Sequence[str | Column],
                payload: Sequence[str] | None = None, chunk_size: int = 1000,
                alias: str = "children", descending: bool = False,
                counts: DataFrame | None = None) -> DataFrame:
    """Rows ``(key, part, parts, <alias>: array<struct>)``.

    ``sort_cols`` lead each struct, so ``sort_array`` orders the elements by
    them (descending when asked); ``payload`` columns follow.  ``counts``
    (``key, _n``: children per key) may be passed when the caller already
    aggregated them, so the children are not counted twice.
    """
    if chunk_size < 1:
        raise ValueError("chunk_size must be >= 1")
    sort_exprs = [F.col(c) if isinstance(c, str) else c for c in sort_cols]
    sort_names = [c for c in sort_cols if isinstance(c, str)]
    payload = [c for c in (payload or children.columns) if c != key and c not in sort_names]
    if counts is None:
        counts = children.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.greatest(F.ceil(F.col("_n") / F.lit(chunk_size)), F.lit(1)).cast("long")
    salted = (children.join(counts, key)
              .withColumn("parts", parts)
              .withColumn("part", F.pmod(F.xxhash64(*sort_exprs, *[F.col(c) for c in payload]),
                                         F.col("parts"))))
    element = F.struct(*sort_exprs, *[F.col(c) for c in payload])
    return (salted.repartition(key, "part").groupBy(key, "part", "parts")
            .agg(F.sort_array(F.collect_list(element), asc=not descending).alias(alias)))
