"""Line dedup by a deletion-neighbourhood join, in DataFrame operations.

A line goes where an earlier line of the corpus is equal to it or one edit
away (a character put in, left out or replaced).  Two lines are one edit apart
if they share a deletion variant: both without the character at one position,
or one of them without a character and the other whole.  Variants are hashed,
and equal keys joined:

* lines that share (key, position, length) are all within one edit of each
  other, so each is joined with the earliest only, never with all;
* a whole line is joined with the longer lines that have it as a variant.

Candidates are verified with their edit distance.  A line with no edit in one
of its halves shares that half with its neighbour, so only lines that share a
half with a different line emit variants.  The hash of a variant is made of
the hashes of its blocks, which bounds the work for very long lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import SharedFolder, gapless, text_or_empty

#: Characters of a hashed block.
BLOCK = 256
#: A set of line hashes (16 bytes each) is broadcast up to this many rows; a larger one is joined by key.
BROADCAST_LINES = 500_000
IDENTITY = ["h1", "h2"]


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, line_no, line, h1, h2)`` of every line that is not empty;
    lines with equal 128-bit hashes are taken as equal."""
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.posexplode(F.split(text_or_empty(text_col), "\n", -1)).alias("line_no", "line"))
    return lines.where("line <> ''").withColumns({"h1": F.xxhash64("line"),
                                                  # another seed: with the line first, h2 would follow from h1
                                                  "h2": F.xxhash64(F.lit("second"), "line")})


def half_keys() -> Column:
    """Keys of a line's halves, and of the halves it would have were it the
    line that is one character shorter with a character put in."""
    n = F.length("line")

    def halves(of: Column) -> list[Column]:
        first = F.floor(of / 2).cast("int")
        return [F.xxhash64(of, F.lit("first"), F.substr("line", F.lit(1), first)),
                F.xxhash64(of, F.lit("last"), F.substr("line", n - (of - first) + 1))]

    return F.array(*halves(n), *halves(n - 1))


def variants(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``texts(ord, line)``, ``ord`` a number: the key of every whole line and the
    keys of the lines without one of their characters."""
    n = F.length("line")
    starts = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))

    def hashed(text: Column, t: Column) -> Column:
        return F.when(F.length(text) > 0, F.xxhash64(text, t)).otherwise(F.lit(0).cast("long"))

    def folded(keys: Column) -> Column:
        return F.aggregate(keys, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))

    base = texts.select("ord", n.alias("n"), "line", starts.alias("starts"))
    base = base.withColumns({
        "own": F.transform("starts", lambda t: hashed(F.substr("line", t * BLOCK + 1, F.lit(BLOCK)), t)),
        "moved": F.transform("starts", lambda t: hashed(F.substr("line", t * BLOCK + 2, F.lit(BLOCK)), t))})
    whole = base.select("ord", "n", folded(F.col("own")).alias("key"))
    blocks = base.select("ord", "n", F.explode(F.transform("starts", lambda t: F.struct(
        t.alias("t"), F.substr("line", t * BLOCK + 1, F.lit(BLOCK + 1)).alias("b"),
        folded(F.slice("own", F.lit(1), t)).bitwiseXOR(
            folded(F.slice("moved", t + 2, F.size("moved")))).alias("rest")))).alias("e"))
    blocks = blocks.select("ord", "n", "e.*")
    at = F.sequence(F.lit(0), F.least(F.length("b"), F.lit(BLOCK)) - 1)
    without = blocks.select("ord", "n", F.explode(F.transform(at, lambda j: F.struct(
        (F.col("t") * BLOCK + j).alias("at"),
        hashed(F.concat(F.substr("b", F.lit(1), j), F.substr("b", j + 2, F.lit(BLOCK))), F.col("t"))
        .bitwiseXOR(F.col("rest")).alias("key")))).alias("e"))
    return whole, without.select("ord", "n", "e.at", "e.key")


def neighbours(texts: DataFrame, folder: SharedFolder) -> DataFrame:
    """``(h1, h2, earlier)``: for every line of ``texts(h1, h2, ord, line)``
    with an earlier one a single edit away, the place of the earliest of those.

    The lines are numbered in their order first, so that a variant carries a
    number and not a place."""
    ranged = texts.repartitionByRange("ord").withColumns({"all": F.lit(0), "part": F.spark_partition_id()})
    numbered = folder.write(gapless(folder.write(ranged, "ranged"), "all", F.col("part"), [F.col("ord")], "num")
                            .select("num", "ord", "line", *IDENTITY), "numbered")
    folder.drop("ranged")
    # a line grows by the square of its block when its variants are made: spread them first
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = numbered.select(F.col("num").alias("ord"), "line").repartition(tasks, "ord")
    whole, without = variants(spread)
    without = folder.write(without, "variants")
    star = without.groupBy("key", "n", "at").agg(F.min("ord").alias("to"))
    replaced = (without.join(star, ["key", "n", "at"]).where(F.col("ord") > F.col("to"))
                .select(F.col("ord").alias("x"), F.col("to").alias("y")).distinct())
    short = whole.select("key", (F.col("n") + 1).alias("n"), F.col("ord").alias("short"))
    put_in = without.select("key", "n", "ord").distinct().join(short, ["key", "n"])
    put_in = put_in.select(F.greatest("ord", "short").alias("x"), F.least("ord", "short").alias("y"))
    pairs = replaced.union(put_in).distinct()
    x = numbered.select(F.col("num").alias("x"), F.col("line").alias("lx"), *IDENTITY)
    y = numbered.select(F.col("num").alias("y"), F.col("line").alias("ly"), "ord")
    near = pairs.join(x, "x").join(y, "y").where(F.levenshtein("lx", "ly", 1) == 1)
    near = folder.write(near.groupBy(*IDENTITY).agg(F.min("ord").alias("earlier")), "near")
    folder.drop("variants")
    return near


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """One row per line that goes: doc_id, line_no (from 0), keep_doc_id,
    keep_line_no (the earliest line equal to it or, if there is an earlier
    one, a single edit away) and distance (0 or 1).

    Lines are ordered by document id, null last, and place.  Empty lines and
    null or empty texts have no part.  "Earliest" looks at all lines, also at
    those that go themselves.  Rows that repeat an id and a text repeat its
    lines, which then stand at the same place and are told apart by nothing:
    they stay or go together.
    """
    folder = SharedFolder(docs.sparkSession, "lines")
    lines = split_lines(docs)
    places = folder.write(lines.select("doc_id", "line_no", *IDENTITY, half_keys().alias("halves")), "places")
    ord_ = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line_no", "h1")
    classes = folder.write(places.groupBy(*IDENTITY).agg(F.min(ord_).alias("ord"),
                                                         F.first("halves").alias("halves")), "classes")
    halves = classes.select(*IDENTITY, F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("half")
    asked = folder.write(halves.join(shared, "half", "left_semi").select(*IDENTITY).distinct(), "asked")
    known = F.broadcast(asked) if asked.count() <= BROADCAST_LINES else asked
    texts = lines.select(*IDENTITY, "line").join(known, IDENTITY, "left_semi")
    texts = texts.groupBy(*IDENTITY).agg(F.first("line").alias("line"))
    texts = folder.write(texts.join(classes.select(*IDENTITY, "ord"), IDENTITY), "texts")
    near = neighbours(texts, folder)
    decided = classes.select(*IDENTITY, "ord").join(near, IDENTITY, "left")
    keep = F.coalesce("earlier", "ord")
    out = places.select("doc_id", "line_no", *IDENTITY).join(decided, IDENTITY)
    first = F.col("doc_id").eqNullSafe(F.col("ord.doc_id")) & (F.col("line_no") == F.col("ord.line_no"))
    return out.where(~first | F.col("earlier").isNotNull()).select(
        "doc_id", "line_no", keep["doc_id"].alias("keep_doc_id"), keep["line_no"].alias("keep_line_no"),
        F.when(F.col("earlier").isNull(), 0).otherwise(1).alias("distance"))
