"""Substring search through a trigram index.

``ILIKE '%term%'`` over a table reads all of it.  The index holds, for every run
of three characters (lower case) of a text column, the keys of the rows where it
occurs: postings ``(gram, block, ids)``, one row for a gram and a block of
``BLOCK`` consecutive keys, sorted by gram, so that a gram's postings lie together
and a common gram is many small rows, not one large one.  ``ids`` tells the keys
by bits: a number for each ``WORD`` consecutive keys of the block that hold any.

Rows are dealt by block, some ``ROWS`` to a task, before their grams are written
out, so only the searched texts and the finished postings travel between tasks.

A search cuts its pattern at the live wildcards ``%`` and ``_`` into literal
parts.  The grams of the parts are looked up by a pushed filter, and the bits of
all grams are ANDed number by number.  The rows left are candidates: a
superset of the matches, since a match has every gram in one of its columns.
The reference's ILIKE then decides.  The candidates' key ranges, ``RANGES`` at
most, go to the table's scan as a pushed filter, so only row groups that hold
candidates are read; a semi join keeps the candidates themselves.  A pattern
without a part of three characters has no grams and reads the table.

New rows come in as further batches (searched texts do not change; a status
change does not touch the index).  A block that got rows from several batches has
several postings for a gram, which are ORed before the grams are ANDed.
A batch is visible once its marker, written last, is there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.functions.predicates import like_pattern, search_any
from orderlens.sources.optional import read_parquet_if_present

GRAM = 3
#: Keys of a block, a power of two (``block`` is its first key): one posting tells of these at most.
BLOCK = 4096
#: Keys that the bits of one number tell.
WORD = 64
#: Blocks whose postings of a gram lie in one file; a common gram has several such stretches.
STRETCH = 1024
#: Rows of a task that builds postings, if keys are spread evenly.
ROWS = 100_000
#: Key ranges that a scan's filter names at most.
RANGES = 256
#: Literal keys that a scan's filter names at most (the session's ``inFilterThreshold``).
KEYS = 1000


def _grams(text: Column) -> Column:
    """The distinct runs of three characters of a lower-case text, none for a shorter or null one."""
    low = F.lower(text)
    runs = F.transform(F.sequence(F.lit(1), F.length(low) - (GRAM - 1)), lambda i: F.substring(low, i, F.lit(GRAM)))
    return F.when(F.length(low) >= GRAM, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _any(preds: list[Column]) -> Column:
    """OR of the predicates as a balanced tree: a chain of hundreds is too deep for the planner's recursion."""
    if len(preds) == 1:
        return preds[0]
    middle = len(preds) // 2
    return _any(preds[:middle]) | _any(preds[middle:])


@dataclass(frozen=True)
class SearchIndex:
    """The index below ``root`` over the ``columns`` (as text) of a table with the whole-number key ``key``."""

    spark: SparkSession
    root: str
    key: str
    columns: tuple[str, ...]

    # --- building

    def add(self, rows: DataFrame, batch_id: int = 0) -> None:
        """Index rows that are new to the table; a replayed batch replaces its own postings."""
        key = F.col(self.key).cast("long")
        told = rows.where(key.isNotNull()).select(
            key.bitwiseAND(F.lit(-BLOCK)).alias("block"), key.bitwiseAND(F.lit(BLOCK - 1)).alias("_at"),
            *[F.col(c).cast("string").alias(f"_text{i}") for i, c in enumerate(self.columns)])
        parts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = told.repartition(max(parts, -(-told.count() // ROWS)), "block")
        grams = reduce(F.array_union, [_grams(F.col(f"_text{i}")) for i in range(len(self.columns))])
        # dealt by block, so neither grouping needs another shuffle; whole numbers are added up in place
        bits = (dealt.select("block", "_at", F.explode(grams).alias("gram"))
                .groupBy("block", "gram", F.call_function("div", F.col("_at"), F.lit(WORD)).cast("int").alias("word"))
                .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("_at", F.lit(WORD)).cast("int"))).alias("bits")))
        postings = bits.groupBy("block", "gram").agg(F.collect_list(F.struct("word", "bits")).alias("ids")).select("gram", "block", "ids")
        # by hash: ranges would be found by building all postings twice
        stretch = F.call_function("div", F.col("block"), F.lit(BLOCK * STRETCH))
        (postings.repartition(parts, F.col("gram"), stretch).sortWithinPartitions("gram", "block")
         .write.mode("overwrite").parquet(f"{self.root}/postings/batch_id={batch_id}"))
        marker = self.spark.range(1).select(F.lit(True).alias("committed"))
        marker.write.mode("overwrite").parquet(f"{self.root}/_commits/batch_id={batch_id}")

    def postings(self) -> DataFrame | None:
        """Postings of the committed batches; None before the first."""
        markers = read_parquet_if_present(self.spark, f"{self.root}/_commits")
        stored = None if markers is None else read_parquet_if_present(self.spark, f"{self.root}/postings")
        return None if stored is None else stored.join(markers.select("batch_id").distinct(), "batch_id", "left_semi")

    # --- searching

    def _parts(self, term: str) -> list[str]:
        """The literal parts of the pattern as ILIKE compares them, lowered by the engine's own rule."""
        low = self.spark.range(1).select(F.lower(F.lit(like_pattern(term)))).first()[0]
        return [p for p in re.split("[%_]", low.replace("\\\\", "\\")) if len(p) >= GRAM]

    def candidates(self, term: str) -> DataFrame | None:
        """The keys of rows that hold every gram of the term; None if it has no gram."""
        grams = sorted({p[i:i + GRAM] for p in self._parts(term) for i in range(len(p) - GRAM + 1)})
        stored = self.postings()
        if not grams or stored is None:
            return None
        bits = stored.where(F.col("gram").isin(grams)).select("block", "gram", F.inline("ids"))
        met = (bits.groupBy("block", "word", "gram").agg(F.bit_or("bits").alias("bits"))  # batches of one block
               .groupBy("block", "word").agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
               .where((F.col("n") == len(grams)) & (F.col("bits") != 0)))
        places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit("bits", i) == 1)
        first = F.col("block") + F.col("word") * F.lit(WORD)
        return met.select(F.explode(F.transform(places, lambda i: first + i)).alias(self.key))

    def _restricted(self, rows: DataFrame, wanted: DataFrame) -> DataFrame:
        """Rows whose key is wanted, with the keys or their ranges pushed to the scan."""
        few = [r[0] for r in wanted.limit(KEYS + 1).collect()]
        if len(few) <= KEYS:
            return rows.where(F.col(self.key).isin(few)) if few else rows.where(F.lit(False))
        ends = wanted.agg(F.min(self.key).alias("lo"), F.max(self.key).alias("hi")).first()
        width = (ends["hi"] - ends["lo"]) // RANGES + 1
        place = F.call_function("div", F.col(self.key) - F.lit(ends["lo"]), F.lit(width))
        used = sorted((r["lo"], r["hi"]) for r in wanted.groupBy(place).agg(F.min(self.key).alias("lo"), F.max(self.key).alias("hi")).collect())
        ranges: list[list[int]] = []
        for lo, hi in used:  # neighbours become one range
            if ranges and lo - ranges[-1][1] <= width:
                ranges[-1][1] = hi
            else:
                ranges.append([lo, hi])
        pushed = _any([F.col(self.key).between(F.lit(lo), F.lit(hi)) for lo, hi in ranges])
        return rows.where(pushed).join(wanted, self.key, "left_semi")

    def search(self, rows: DataFrame, term: str | None) -> DataFrame:
        """The rows of the table whose columns match the term: those of ``search_any`` over all of it."""
        pred = search_any(term, [F.col(c).cast("string") for c in self.columns])
        if pred is None:
            return rows
        wanted = self.candidates(term)
        return rows.where(pred) if wanted is None else self._restricted(rows, wanted).where(pred)


def order_index(spark: SparkSession, root: str) -> SearchIndex:
    """the order list's search columns."""
    return SearchIndex(spark, root.rstrip("/"), "order_id", ("user_name", "user_phone", "user_email", "order_id"))


def customer_index(spark: SparkSession, root: str) -> SearchIndex:
    """the customer list's search columns."""
    return SearchIndex(spark, root.rstrip("/"), "id", ("full_name", "phone", "email"))
