"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its weighted share of the wanted words, held below a
number of epochs of the source; what the held sources leave is reshared by
weight.  Whole epochs come first.  The rest of a target is filled by weighted
sampling without replacement: a document gets the key ``-ln(u) / q`` with its
quality weight ``q`` and a uniform ``u`` from a hash of its id, so reruns
agree; the documents of a source are taken in the order of their keys until
the prefix sum of their sizes reaches the rest.

The prefix sums are taken over key ranges that narrow down around the budget
(:func:`~orderlens.llm.common.weighted_cuts`), so a source that holds a third
of all rows is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import SPACES, SharedFolder, gapless, text_or_empty, weighted_cuts, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Keys are kept in steps of 2**-KEY_SCALE; the largest possible key,
#: 53 ln 2 / 0.05 < 2**10, needs 10 more bits.
KEY_SCALE = 34
KEY_BITS = KEY_SCALE + 10
#: A table of at most this many sources is broadcast; a larger one is joined by key.
BROADCAST_SOURCES = 10_000


def quality_weight(text: Column) -> Column:
    """0.05 to 1: the square of the share of letters among the characters
    that are not white space (empty text: 0.05)."""
    letters = F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("double")
    solid = F.length(F.translate(text, SPACES, ""))
    share = F.when(solid > 0, letters / solid).otherwise(F.lit(0.0))
    return F.lit(0.05) + F.lit(0.95) * share * share


def sampling_key(doc_id: Column, weight: Column) -> Column:
    """Efraimidis-Spirakis key as a whole number: smaller keys go first."""
    digest = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return F.floor(-F.log(u) / weight * F.lit(float(2**KEY_SCALE))).cast("long")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(row, source, size, key)`` of every document; ``row`` holds all its columns."""
    text = text_or_empty(text_col)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(source_col).alias("source"), word_count(text).alias("size"),
                       sampling_key(F.col(id_col), quality_weight(text)).alias("key"))


def source_targets(sizes: DataFrame, folder: SharedFolder, weights=WEIGHTS, share: float = SHARE,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(g, source, source_size, target)`` from ``sizes(source, source_size)``.

    Sources are numbered by code point, null last; their weights repeat.  The
    level that a unit of weight gets rises until what the held sources leave
    is used up; every step is one aggregate over the sources.
    """
    ranged = (sizes.repartitionByRange(F.col("source").isNull(), F.col("source"))
              .withColumn("all", F.lit(0)).withColumn("part", F.spark_partition_id()))
    ranged = folder.write(ranged, "sources-ranged")
    numbered = gapless(ranged, "all", F.col("part"), [F.col("source").isNull(), F.col("source")], "g")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("g") % len(weights) + 1).cast("int"))
    numbered = folder.write(numbered.select("g", "source", "source_size", weight.alias("weight"),
                                            (F.col("source_size") * F.lit(float(max_epochs))).alias("cap")), "sources")
    words, open_weight = numbered.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted, level = share * (words or 0), 0.0
    if open_weight:
        level = wanted / open_weight
        while True:
            held = F.col("cap") <= F.lit(level) * F.col("weight")
            capped, open_weight = numbered.agg(F.sum(F.when(held, F.col("cap"))),
                                               F.sum(F.when(~held, F.col("weight")))).first()
            if not open_weight:
                level = float("inf")
                break
            risen = (wanted - (capped or 0.0)) / open_weight
            if risen <= level:
                break
            level = risen
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return numbered.select("g", "source", "source_size", target.alias("target"))


def plan_mixture(rows: DataFrame, folder: SharedFolder, weights=WEIGHTS, share: float = SHARE,
                 max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size, target, epochs, cut)``: the whole epochs of each
    source and the largest key of the fractional one (-1: none is taken)."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(folder.write(sizes, "sizes"), folder, weights, share, max_epochs)
    size = F.col("source_size")
    epochs = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("int")
    targets = targets.withColumn("epochs", epochs)
    targets = folder.write(targets.withColumn("want", F.col("target") - F.col("epochs") * size), "targets")
    small = targets.select("g", F.col("source").alias("of"))
    keyed = rows.join(_sized(small, targets), F.col("source").eqNullSafe(F.col("of")))
    keyed = folder.write(keyed.where("size > 0").select("g", F.col("key").alias("k"), F.col("size").alias("w")), "keys")
    cuts = weighted_cuts(keyed, targets.select("g", "want"), KEY_BITS, folder, "mix").withColumnRenamed("g", "_g")
    nearest = F.when(F.col("through") - F.col("want") <= F.col("want") - F.col("below"), F.col("cut"))
    nearest = nearest.otherwise(F.col("cut") - 1)
    plan = targets.join(cuts, F.col("g") == F.col("_g"), "left")
    return folder.write(plan.select("source", "source_size", "target", "epochs",
                                    F.coalesce(nearest, F.lit(-1)).cast("long").alias("cut")), "plan")


def _sized(side: DataFrame, stored: DataFrame) -> DataFrame:
    """Broadcast a table of sources only where it is small."""
    return F.broadcast(side) if stored.count() <= BROADCAST_SOURCES else side


def mixed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with source_size, target and ``taken``: the words that the mix
    takes of each document, repeats counted (0: it is left out)."""
    side = plan.withColumnRenamed("source", "_of")
    out = rows.join(_sized(side, plan), F.col("source").eqNullSafe(F.col("_of")))
    once_more = F.when(F.col("key") <= F.col("cut"), 1).otherwise(0)
    return out.withColumn("copies", F.col("epochs") + once_more).withColumn(
        "taken", (F.col("size") * F.col("copies")).cast("long")).drop("_of", "epochs", "cut")


def mix_table(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    Null text or no word: size 0, taken 0.  A null source is a source of its
    own, the last.  Rows that repeat an id share its key, so they are taken or
    left together.  An empty table gives an empty result.
    """
    folder = SharedFolder(docs.sparkSession, "mix")
    rows = folder.write(measured(docs.select("doc_id", "text", "source")).select("row.doc_id", "source", "size", "key"),
                        "measured")
    return mixed(rows, plan_mixture(rows, folder)).select("doc_id", "source", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The rows of the mix with the columns of ``docs``: a document stands
    there as often as it is taken.  Documents without a word have nothing to
    repeat and stay once."""
    folder = SharedFolder(docs.sparkSession, "mix")
    rows = measured(docs)
    out = mixed(rows, plan_mixture(rows.select("source", "size", "key"), folder))
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))
    return (out.where(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).select("row.*"))
