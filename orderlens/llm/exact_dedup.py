"""Exact dedup: an extendible-hash index in the shared folder.

The index keys a document by the 64-bit hash of its normalised text (the text
without white space).  A directory of hash prefixes doubles while a bucket
holds more rows than its capacity; a bucket that cannot be split (a hot group
of copies, whose hash is one value) grows a chain of overflow pages instead,
and its rows are dealt over the pages.  Owner tasks take one range of pages
each: they group the entries of a page by hash and then by the bytes of the
normalised text, so that colliding hashes stay apart, and write the page to
the shared folder.  A second, much smaller step joins equal texts of the pages
of one chain.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import SPACES, SharedFolder, text_or_empty

#: Longest hash prefix of the directory: at most 2**16 entries at any size.
MAX_DEPTH = 16
#: Rows a bucket holds before it is split; grows only where the directory has
#: reached its longest prefix (2**16 buckets of this size are 134 million rows).
CAPACITY = 2048

#: Columns of a bucket while the directory is made.
DIRECTORY = pa.schema([("first", pa.int32()), ("span", pa.int32()), ("first_page", pa.int32()), ("pages", pa.int32()),
                       ("before", pa.int64()), ("rows", pa.float64())])


def normalised(name: str = "text") -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(text_or_empty(name), SPACES, "")


@dataclass
class Directory:
    """``table`` has one row per directory entry: its bucket's first page, its
    pages, the rows of all buckets before and the rows of each page."""

    table: DataFrame
    pages: int
    rows: int


def split_buckets(counts: np.ndarray, capacity: int) -> list[tuple[int, int, int]]:
    """Double the directory until no bucket is overfull or the prefix is at
    its longest: (first entry, entries, rows) of each bucket, by prefix."""
    longest = int(counts.size).bit_length() - 1
    depth, open_buckets, done = 0, np.array([0]), []
    while open_buckets.size:
        sizes = counts.reshape(2**depth, -1).sum(axis=1)[open_buckets]
        stay = (sizes <= capacity) | (depth == longest)
        span = 2 ** (longest - depth)
        done += [(int(b) * span, span, int(n)) for b, n in zip(open_buckets[stay], sizes[stay])]
        grown = open_buckets[~stay]
        open_buckets, depth = np.concatenate([grown * 2, grown * 2 + 1]), depth + 1
    return sorted(done)


def build_directory(hashes: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> Directory:
    """``hashes(h)``: one row per document.  Only the row counts of the
    2**max_depth prefixes reach the driver."""
    spark = hashes.sparkSession
    prefix = F.shiftrightunsigned("h", 64 - max_depth).cast("int")
    counts = np.zeros(2**max_depth, dtype=np.int64)
    for row in hashes.groupBy(prefix.alias("prefix")).count().collect():  # at most 2**max_depth rows
        counts[row["prefix"]] = row["count"]
    room = max(capacity, -(-2 * int(counts.sum()) // 2**max_depth))
    rows, page, before = [], 0, 0
    for first, span, n in split_buckets(counts, room):
        chain = max(1, -(-n // room))
        rows.append((first, span, page, chain, before, n / chain))
        page, before = page + chain, before + n
    # as an Arrow table, which the JVM reads; rows of Python objects would start Python workers of another kind,
    # beside those of the other operators
    buckets = spark.createDataFrame(pa.table([pa.array(v, t) for v, t in zip(zip(*rows), DIRECTORY.types)], schema=DIRECTORY))
    entries = buckets.select(F.explode(F.sequence("first", F.col("first") + F.col("span") - 1)).alias("prefix"),
                             "first_page", "pages", "before", "rows")
    return Directory(entries, page, before)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                max_depth: int = MAX_DEPTH) -> DataFrame:
    """Index every row of ``docs`` and write the index to the shared folder.

    Returns one row per page and different text: ``page``, ``chained`` (more
    pages may hold this text), ``h``, ``text_sha256`` (of the normalised
    text), ``norm`` (only where chained), ``n``, ``ids`` (the ids of its rows;
    a page holds a bounded number), ``keep_id`` and ``row``: all columns of
    the row that stays.  Rows whose text is null count as empty texts; rows
    with a null id rank after all others of the same length; an empty table
    gives an empty index.  Columns of ``docs`` keep their names inside
    ``row`` and clash with nothing.
    """
    folder = SharedFolder(docs.sparkSession, "index")
    norm = normalised(text_col)
    directory = build_directory(docs.select(F.xxhash64(norm).alias("h")), capacity, max_depth)
    entries = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                          F.xxhash64(norm).alias("h"), F.col(id_col).cast("long").alias("id"))
    entries = entries.withColumn("prefix", F.shiftrightunsigned("h", 64 - max_depth).cast("int"))
    # the directory has at most 2**max_depth rows of 32 bytes
    entries = entries.join(F.broadcast(directory.table), "prefix")
    link = F.pmod(F.xxhash64("id", F.lit("page")), F.col("pages"))
    owners = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owner = ((F.col("before") + link * F.col("rows")) * F.lit(owners / max(1, directory.rows))).cast("int")
    entries = entries.select(owner.alias("owner"), (F.col("first_page") + link).cast("int").alias("page"),
                             (F.col("pages") > 1).alias("chained"), "h", "id", "row")
    owned = entries.repartitionById(owners, "owner")
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    order = F.struct(F.length(text).alias("points"), F.col("id").isNotNull().alias("has_id"),
                     F.bitwise_not(F.col("id")).alias("before"), text.alias("text"))
    index = (owned.withColumn("norm", F.translate(text, SPACES, ""))
             .groupBy("owner", "page", "chained", "h", "norm")
             .agg(F.max_by("row", order).alias("row"), F.max_by("id", order).alias("keep_id"),
                  F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("id")).alias("ids"))
             .select("page", "chained", "h", F.sha2("norm", 256).alias("text_sha256"),
                     F.when(F.col("chained"), F.col("norm")).alias("norm"), "n", "ids", "keep_id", "row"))
    return folder.write(index, "pages")


def _stays(text_col: str) -> Column:
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    return F.struct(F.length(text), F.col("keep_id").isNotNull(), F.bitwise_not(F.col("keep_id")), text)


def memberships(index: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Rows that repeat the id and the text of the row that stays are all marked
    kept (they are one document written twice); a null id stays only where its
    group has no other id.
    """
    single = index.where(~F.col("chained")).select("ids", "keep_id", F.col("n").alias("group_size"), "text_sha256")
    chained = index.where("chained")
    joined = (chained.groupBy("h", "norm")
              .agg(F.max_by("keep_id", _stays(text_col)).alias("keep_id"), F.sum("n").alias("group_size")))
    chain = (chained.select("h", "norm", "ids", "text_sha256").join(joined, ["h", "norm"])
             .select("ids", "keep_id", "group_size", "text_sha256"))
    rows = single.unionByName(chain).withColumn("m", F.explode("ids"))
    return rows.select(F.col("m.id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"),
                       F.col("m.id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with exactly one row of each group of equal texts: the one
    with the most code points in its original text, then the smallest id."""
    index = build_index(docs, id_col, text_col)
    single = index.where(~F.col("chained")).select("row")
    chain = (index.where("chained").groupBy("h", "norm").agg(F.max_by("row", _stays(text_col)).alias("row"))
             .select("row"))
    return single.unionByName(chain).select("row.*")
