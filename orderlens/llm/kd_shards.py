"""Sharding by a k-d tree over document metadata, in DataFrame operations.

A node of the tree holds a number of shards.  It is cut along the dimension in
which its documents spread widest (source, language, characters, bytes; each
scaled to the whole table) at the weighted median of that dimension, or, where
its shards are odd, at the weighted quantile that gives each side the bytes of
its shards.  Documents with the same value are told apart by a hash of their
id, so a source with a third of all rows is cut like any other.  The medians
of all nodes of a level are found together from sums per key range; rows move
only when a level is written to the shared folder, never to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import SharedFolder, gapless, text_or_empty, weighted_cuts

SHARDS = 24
#: Bits of the dimension and of the tie hash in a cut key.
VALUE_BITS, TIE_BITS = 20, 28
#: Rows that one task numbers.
NUMBERED_ROWS = 20_000
DIMENSIONS = ("d_source", "d_lang", "d_chars", "d_bytes")


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the dimensions of every document.

    Names become numbers by their crc32 (null: 0); a null character count is 0.
    """
    text = text_or_empty("text")
    size = (F.octet_length(text) + 8).cast("long")
    names = [F.coalesce(F.crc32(F.col(c)), F.lit(0)).cast("double").alias(d)
             for c, d in (("source", "d_source"), ("lang", "d_lang"))]
    return docs.select("doc_id", size.alias("size"), F.crc32(text).cast("long").alias("text_crc32"), *names,
                       F.coalesce(F.col("n_chars"), F.lit(0)).cast("double").alias("d_chars"),
                       size.cast("double").alias("d_bytes"))


def _by_node(values: dict[int, float], nodes: int, other: float, kind: str) -> Column:
    """The value of a row's node, from a list as long as the tree is wide."""
    return F.array(*[F.lit(values.get(i, other)).cast(kind) for i in range(nodes)])[F.col("node")]


def kd_tree(rows: DataFrame, shards: int, folder: SharedFolder) -> DataFrame:
    """``rows`` with ``node``: the shard, 0 to ``shards`` - 1."""
    spark = rows.sparkSession
    tie = F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "size"), 64 - TIE_BITS)
    rows = folder.write(rows.withColumn("tie", tie).withColumn("node", F.lit(0)), "level0")
    spreads = [f(d).alias(f"{f.__name__}_{d}") for d in DIMENSIONS for f in (F.min, F.max)]
    held = {0: shards}  # node (its first shard) -> number of its shards
    whole: dict[str, float] = {}
    level = 0
    while any(n > 1 for n in held.values()):
        stats = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *spreads).collect()  # at most a row per shard
        wants, dims, low, span = [], {}, {}, {}
        for s in stats:
            spread = {d: (s[f"max_{d}"] - s[f"min_{d}"]) for d in DIMENSIONS}
            if level == 0:
                whole = {d: v or 1.0 for d, v in spread.items()}
            node, n = s["node"], held[s["node"]]
            if n < 2:
                continue
            widest = max(DIMENSIONS, key=lambda d: spread[d] / whole[d])
            dims[node] = DIMENSIONS.index(widest)
            low[node], span[node] = s[f"min_{widest}"], spread[widest] or 1.0
            wants.append((node, s["bytes"] * (n // 2) / n))
        value = F.array(*[F.col(d) for d in DIMENSIONS])[_by_node(dims, shards, 0, "int")]
        scaled = (value - _by_node(low, shards, 0.0, "double")) / _by_node(span, shards, 1.0, "double")
        step = F.least(F.floor(scaled * F.lit(2**VALUE_BITS - 1)), F.lit(2**VALUE_BITS - 1)).cast("long")
        key = F.when(_by_node(dims, shards, -1, "int") >= 0, F.shiftleft(step, TIE_BITS) + F.col("tie"))
        keyed = rows.withColumn("k", key)
        targets = folder.write(spark.createDataFrame(wants, "g int, want double").coalesce(1), f"wants{level}")
        cuts = weighted_cuts(keyed.where("k IS NOT NULL").select(F.col("node").alias("g"), "k",
                                                                 F.col("size").alias("w")),
                             targets, VALUE_BITS + TIE_BITS, folder, f"level{level}")
        want = dict(wants)
        at = {c["g"]: c["cut"] if c["through"] - want[c["g"]] <= want[c["g"]] - c["below"] else c["cut"] - 1
              for c in cuts.collect()}  # at most a row per shard
        right = {node: node + held[node] // 2 for node in at}
        moved = F.when(F.col("k") > _by_node(at, shards, 0, "long"), _by_node(right, shards, 0, "int"))
        rows = folder.write(keyed.withColumn("node", F.coalesce(moved, F.col("node"))).drop("k"), f"level{level + 1}")
        folder.drop(f"level{level}")
        held = {part: n for node, m in held.items()
                for part, n in ([(node, m // 2), (node + m // 2, m - m // 2)] if m > 1 else [(node, m)])}
        level += 1
    return rows


def shard_documents(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    ``shards`` or ``target_bytes`` (of a leaf) sets how far the tree goes.
    Shards follow the law ``bytes``: their sizes are near equal, off by about
    the size of a document.  ``slot`` numbers the rows of a shard from 0.
    Null text has no bytes; nulls in other columns count as zero; rows that
    repeat id and text fall into one shard.  An empty table gives an empty result.
    """
    folder = SharedFolder(docs.sparkSession, "shards")
    rows = folder.write(metadata(docs), "metadata")
    count, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    if shards is None:
        shards = max(1, -(-(total or 0) // target_bytes))
    rows = kd_tree(rows, shards, folder) if count else rows.withColumn("node", F.lit(0))
    buckets = max(1, -(-count // (shards * NUMBERED_ROWS)))
    out = gapless(rows, "node", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)),
                  [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
                      F.col("node").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
