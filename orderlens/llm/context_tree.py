"""Language-model scoring by context-tree weighting over bytes.

A text is its words (lower case A-Z, runs outside white space) joined by one
space, and an end mark, a byte that UTF-8 never has; it begins in the context
of ``depth`` end marks.  Every byte is eight binary decisions.  Each decision
(the bits of the byte so far) has a context tree of its own over the ``depth``
bytes before it.  A node of a tree holds how often either bit followed there;
its estimate is Krichevsky and Trofimov's.  The weighted probability of a node
is half its own estimate and half the product of those of its children, so
trees of every depth are mixed.  The probability of the next bit is then exact:
going down the path of contexts, a node's own estimate counts with the share
that it has in its weighted probability, the rest goes to the child.

How it is spread:

* The documents are read once, in chunks of ``CHUNK`` bytes of training or of
  held-out texts.  A chunk hands on its distinct runs of ``depth + 1`` bytes
  and its distinct words, with counts (0 from held-out texts), dealt into
  buckets: runs by the last ``depth - 2`` bytes of their context, words by a
  hash.  The counts cover the whole corpus; nothing of them is dropped, and two
  runs or words are never taken for one.
* A bucket adds up what the chunks gave it, one chunk at a time.  It holds the
  two deepest levels of its contexts' trees and weighs them in arrays.  The
  levels above, each a small part of the next, are tables with a row for a
  node: upward each sums its children, downward each mixes its estimate in.
* The bucket then answers every chunk with the probabilities of its runs and the
  counts of its words, and a chunk is scored at once.  The model is never whole
  in one place.  Contexts that agree in ``depth - 2`` bytes have 2**24 runs at
  most, so a bucket can be made as small as that by more buckets; a task holds a
  bucket's distinct runs and words, or a chunk with its own.

A null text is empty.  Rows are scored one by one, also those that share an id
or a text; a null id is in no fold: it is scored and learned from, not held
out.  A text longer than a chunk is a chunk of its own, read in pieces that
overlap by ``depth`` bytes.  An empty table gives an empty result; where nothing
is learned from, every bit has a half and the base score is 0.  Columns besides
id and text are not read.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import SharedFolder, fold, ship_package

DEPTH = 5
END = b"\xff"
#: Bytes of text whose runs are handed on, and later scored, together; bytes whose runs are ranked at once.
CHUNK, PIECE = 32 << 20, 4 << 20
#: Entries of a table of ranks; beyond them ranks come from sorting.
DENSE = 1 << 25
#: Depths below a bucket's contexts.
INNER = 2


def normalised(text: bytes) -> bytes:
    """Words of lower case, one space between them (bytes.split knows U+0009 to U+000D and the space)."""
    return b" ".join(text.lower().split())


def units(body: bytes, depth: int, piece: int) -> Iterator[bytes]:
    """A text in pieces of at most ``piece`` symbols, each behind its context."""
    whole = END * depth + body + END
    for at in range(0, len(body) + 1, piece):
        yield whole[at:at + depth + piece]


def runs(parts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct runs (``depth`` bytes and the next) in ``parts`` as
    numbers, the place of each position's run among them, and the positions of
    each part."""
    x = np.frombuffer(b"".join(parts), np.uint8)
    lengths = np.array([len(p) for p in parts])
    present = np.bincount(x, minlength=256) > 0
    rank = (np.cumsum(present) - 1).astype(np.int32)
    letters = rank[x]
    base = int(present.sum())
    place, size = letters, base
    for _ in range(depth):  # one byte longer: a run is the place of its head and one letter
        # a table of ranks is small enough for 32 bits; sorting takes 64
        code = place[:-1] if size * base <= DENSE else place[:-1].astype(np.int64)
        code = code * base + letters[len(letters) - len(place) + 1:]
        if size * base <= DENSE:
            seen = np.zeros(size * base, dtype=bool)
            seen[code] = True
            size = int(seen.sum())
            place = np.cumsum(seen, dtype=np.int32)[code] - np.int32(1)
        else:
            found, place = np.unique(code, return_inverse=True)
            size = len(found)
    inside = np.ones(len(place), dtype=bool)  # runs over the border of two parts are none
    borders = np.cumsum(lengths)[:-1]
    inside[(borders[:, None] - depth + np.arange(depth)[None, :]).ravel()] = False
    at = np.flatnonzero(inside)
    place = place[at]
    where = np.full(size, -1, dtype=np.int64)
    where[place] = at
    used = where >= 0
    heads = where[used]
    number = np.zeros(len(heads), dtype=np.int64)
    for k in range(depth + 1):
        number = (number << 8) | x[heads + k]
    return number, (np.cumsum(used) - 1)[place], lengths - depth


def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers of several lists, their counts added up."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    number, count = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.argsort(number, kind="stable")
    number, count = number[order], count[order]
    first = np.concatenate([[True], number[1:] != number[:-1]]) if len(number) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    return number[starts], np.add.reduceat(count, starts) if len(starts) else count


def squeezed(values: bytes) -> bytes:
    """Bytes for a shuffle: their number and, in zstd, themselves."""
    return len(values).to_bytes(8, "little") + pa.compress(values, codec="zstd", asbytes=True)


def released(blob: bytes) -> bytes:
    size = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def packed(numbers: np.ndarray) -> bytes:
    """Sorted numbers as their differences, which compress well."""
    return squeezed(np.diff(numbers, prepend=np.int64(0)).astype("<i8").tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(released(blob), "<i8"))


def run_bucket(number: np.ndarray, depth: int, buckets: int) -> np.ndarray:
    """The bucket of a run: a hash of the last ``depth - INNER`` bytes of its context."""
    context = (number >> 8) & ((1 << 8 * max(depth - INNER, 0)) - 1)
    mixed = (context * np.int64(0x9E3779B1)) & 0xFFFFFFFF
    return ((mixed >> 8) ^ mixed) % buckets


@dataclass
class Chunk:
    """Distinct runs and words of the texts read so far."""

    number: int
    depth: int
    counted: bool
    size: int = 0
    parts: list[bytes] = field(default_factory=list)
    held: int = 0
    found: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    words: Counter = field(default_factory=Counter)

    def add(self, body: bytes) -> None:
        self.size += len(body) + 1
        self.words.update(body.split())
        for part in units(body, self.depth, PIECE):
            self.parts.append(part)
            self.held += len(part)
            if self.held >= PIECE:
                self.fold()

    def fold(self) -> None:
        if self.parts:
            number, place, _ = runs(self.parts, self.depth)
            self.found.append((number, np.bincount(place, minlength=len(number))))
            self.parts, self.held = [], 0
            if len(self.found) > 8:  # the pieces share most of their runs
                self.found = [merged(self.found)]

    def rows(self, buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        """(bucket, runs, their counts, words, their counts) for every bucket with any."""
        self.fold()
        number, count = merged(self.found)
        at = run_bucket(number, self.depth, buckets)
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(np.bincount(at, minlength=buckets))
        words: dict[int, list[bytes]] = {}
        for word in self.words:
            words.setdefault(zlib.crc32(word) % buckets, []).append(word)
        once = 1 if self.counted else 0
        for bucket, mine in enumerate(np.split(order, ends[:-1])):
            own = words.get(bucket, [])
            if len(mine) or own:
                yield (bucket, packed(number[mine]), squeezed((count[mine] * once).astype("<i4").tobytes()),
                       squeezed(b" ".join(own)), squeezed(np.array([self.words[w] * once for w in own], "<i4").tobytes()))


def prepared(docs: DataFrame, held_out: Column, depth: int, buckets: int, chunk_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds: a document (chunk, doc_id, held_out, n_tokens, body)
    and, for each chunk and bucket, runs and words with their counts."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out.alias("held_out"),
                         F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("body"))
    empty = [F.lit(None).cast("binary").alias(c) for c in ("runs", "run_n", "words", "word_n")]
    schema = source.select(F.lit(None).cast("long").alias("chunk"), "doc_id", "held_out", F.lit(None).cast("long").alias("n_tokens"), "body",
                           F.lit(None).cast("int").alias("bucket"), *empty).schema
    for column in schema:
        column.nullable = True  # either kind of row leaves some columns null
    names = schema.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = TaskContext.get().partitionId() << 32
        chunks: dict[bool, Chunk] = {}
        kind = None

        def handed_on(chunk: Chunk) -> Iterator[pa.RecordBatch]:
            for bucket, *blobs in chunk.rows(buckets):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk.number], pa.int64()), pa.nulls(1, kind), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64()),
                     pa.nulls(1, pa.binary()), pa.array([bucket], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], names)

        for batch in batches:
            kind = batch.column(0).type
            at, number, tokens, bodies, size = 0, [], [], [], 0
            for i in range(batch.num_rows):
                body = normalised(batch.column(2)[i].as_py())
                held = batch.column(1)[i].as_py()
                chunk = chunks.get(held)
                if chunk is None:
                    chunk = chunks[held] = Chunk(opened, depth, not held)
                    opened += 1
                chunk.add(body)
                number.append(chunk.number)
                tokens.append((body.count(b" ") + 1 if body else 0) + 1)
                bodies.append(body)
                size += len(body)
                if chunk.size >= chunk_bytes:
                    yield from handed_on(chunks.pop(held))
                if size >= PIECE or i == batch.num_rows - 1:
                    n = len(bodies)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(number, pa.int64()), batch.column(0)[at:at + n], batch.column(1)[at:at + n], pa.array(tokens, pa.int64()),
                         pa.array(bodies, pa.binary()), pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.binary()) for _ in range(4))], names)
                    at, number, tokens, bodies, size = i + 1, [], [], [], 0
        for chunk in chunks.values():
            yield from handed_on(chunk)

    return source.mapInArrow(read, schema)


def log_gamma(x, log=np.log):
    """Stirling's series eight steps up, where it is exact to the last digits; for arrays and, with its logarithm, columns."""
    low = x
    for i in range(1, 8):
        low = low * (x + i)
    y = x + 8
    return ((y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi)
            + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - log(low))


def log_estimate(zeros, ones, log=np.log):
    """Natural logarithm of Krichevsky and Trofimov's probability of so many bits."""
    return log_gamma(zeros + 0.5, log) + log_gamma(ones + 0.5, log) - log_gamma(zeros + ones + 1.0, log) - math.log(math.pi)


@dataclass
class Level:
    """Nodes of one depth; ``above`` is the place of each node's parent in the level above."""

    node: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    weighted: np.ndarray
    stop: np.ndarray
    above: np.ndarray | None = None


class Subtrees:
    """The trees below a bucket's contexts, from its sorted runs and their counts.

    A node's number is its context's bytes and the bits so far (with a leading
    one) as the last byte; a parent's is the same without the first byte.
    """

    def __init__(self, number: np.ndarray, count: np.ndarray, depth: int):
        self.top = max(depth - INNER, 0)
        byte, head, count = number & 255, number >> 8 << 8, count.astype(np.float64)
        self.bits, self.levels = [], []
        for k in range(8):
            node, bit = head | 1 << k | byte >> 8 - k, byte >> 7 - k & 1
            first = np.concatenate([[True], node[1:] != node[:-1]])  # runs are sorted, so a node's are together
            starts, place = np.flatnonzero(first), np.cumsum(first) - 1
            zeros, ones = np.add.reduceat(count * (bit == 0), starts), np.add.reduceat(count * bit, starts)
            own = log_estimate(zeros, ones)
            levels = [Level(node[starts], zeros, ones, own, np.ones(len(starts)))]
            for d in range(depth - 1, self.top - 1, -1):
                below = levels[-1]
                keys, below.above = np.unique(below.node & (1 << 8 * (d + 1)) - 1, return_inverse=True)
                zeros, ones, kids = (np.bincount(below.above, w, len(keys)) for w in (below.zeros, below.ones, below.weighted))
                own = log_estimate(zeros, ones)
                levels.append(Level(keys, zeros, ones, np.logaddexp(own, kids) - math.log(2), 1 / (1 + np.exp(np.minimum(kids - own, 700)))))
            self.bits.append((bit, place))
            self.levels.append(levels)

    def tops(self) -> Level:
        """The nodes of the bucket's contexts."""
        last = [levels[-1] for levels in self.levels]
        return Level(*(np.concatenate([getattr(x, name) for x in last]) for name in ("node", "zeros", "ones", "weighted", "stop")))

    def log10_probabilities(self, node: np.ndarray, given: np.ndarray, left: np.ndarray) -> np.ndarray:
        """For each run the probability of its last byte, from what the levels
        above give to a one and the share they leave, by top node."""
        order = np.argsort(node)
        node, given, left = node[order], given[order], left[order]
        total = 0.0
        for (bit, place), levels in zip(self.bits, self.levels):
            at = np.searchsorted(node, levels[-1].node)
            sums, share = given[at], left[at]
            for level in reversed(levels):
                one = (level.ones + 0.5) / (level.zeros + level.ones + 1)
                if level is not levels[-1]:
                    sums, share = sums[level.above], share[level.above]
                sums, share = sums + share * level.stop * one, share * (1 - level.stop)
            sums = sums[place]
            total = total + np.log10(np.where(bit == 1, sums, 1 - sums))
        return total


def groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Runs of equal keys in a sorted stream, each as a stream of slices (to be used up in turn)."""
    slices = ((key, batch.slice(start, end - start)) for batch in batches if batch.num_rows
              for keys in (batch.column(column).to_numpy(),)
              for ends in (np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)).tolist(),)
              for key, start, end in zip(keys[[0, *ends[:-1]]].tolist(), [0, *ends[:-1]], ends))
    for key, same in itertools.groupby(slices, lambda s: s[0]):
        yield key, (part for _, part in same)


def weigh(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """For each bucket its runs and words with their counts over all chunks, and the nodes of its contexts."""
    for bucket, parts in groups(batches, "bucket"):
        found, waiting, words = [], 0, Counter()
        for part in parts:
            for r in part.to_pylist():
                found.append((unpacked(r["runs"]), np.frombuffer(released(r["run_n"]), "<i4").astype(np.int64)))
                waiting += len(found[-1][0])
                if waiting >= PIECE:  # merged as they come: the bucket's distinct runs are held, not the chunks'
                    found = [merged(found)]
                    waiting = 0
                for word, n in zip(released(r["words"]).split(), np.frombuffer(released(r["word_n"]), "<i4").tolist()):
                    words[word] += n
        number, count = merged(found)
        if len(number):
            tops = Subtrees(number, count, depth).tops()
            n = len(tops.node)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, bucket), pa.int32()), pa.array(tops.node, pa.int64()),
                 *(pa.array(x, pa.float64()) for x in (tops.zeros, tops.ones, tops.weighted, tops.stop)),
                 *(pa.nulls(n, pa.binary()) for _ in range(4)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], WEIGHED)
        counts = np.array(list(words.values()), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int32()), pa.nulls(1, pa.int64()), *(pa.nulls(1, pa.float64()) for _ in range(4)),
             *(pa.array([b], pa.binary()) for b in (packed(number), squeezed(count.tobytes()), squeezed(b" ".join(words)), squeezed(counts.tobytes()))),
             pa.array([int(counts.sum())], pa.int64()), pa.array([int((counts > 0).sum())], pa.int64())], WEIGHED)


WEIGHED = ["bucket", "node", "zeros", "ones", "weighted", "stop", "runs", "run_n", "words", "word_n", "n_words", "n_distinct"]
WEIGHED_SCHEMA = ("bucket int, node long, zeros double, ones double, weighted double, stop double, runs binary, run_n binary, "
                  "words binary, word_n binary, n_words long, n_distinct long")


def answer(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """For each bucket, in this order: its nodes (kind 0), its totals (1), and the chunks' questions (2), each answered."""
    for _, parts in groups(batches, "bucket"):
        node, given, left, number, logp, value = [], [], [], None, None, {}
        for part in parts:
            kinds = part.column("kind").to_numpy()
            inner = part.slice(0, int((kinds == 0).sum()))
            for to, name in ((node, "node"), (given, "given"), (left, "left")):
                to.append(inner.column(name).to_numpy())
            for r in part.slice(inner.num_rows).to_pylist():
                words = released(r["words"]).split()
                if r["kind"] == 1:
                    number = unpacked(r["runs"])
                    value = dict(zip(words, np.log10(np.frombuffer(released(r["word_n"]), "<i8") + 1.0).tolist()))
                    if len(number):
                        tree = Subtrees(number, np.frombuffer(released(r["run_n"]), "<i8"), depth)
                        logp = tree.log10_probabilities(*(np.concatenate(x) for x in (node, given, left)))
                    continue
                asked = unpacked(r["runs"])
                values = np.fromiter(map(value.__getitem__, words), "<f8", len(words))
                own = logp[np.searchsorted(number, asked)] if len(asked) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array([r["chunk"]], pa.int64()),
                                                  *(pa.array([b], pa.binary()) for b in (r["runs"], squeezed(own.astype("<f8").tobytes()), r["words"], squeezed(values.tobytes())))],
                                                 ["of_chunk", "runs", "logp", "words", "value"])


def upper_levels(tops: DataFrame, top: int, folder: SharedFolder) -> DataFrame:
    """``(bucket, node, given, left)`` for the buckets' top nodes: what the
    levels above give to a one, and the share they leave."""
    if top == 0:
        return tops.select("bucket", "node", F.lit(0.0).alias("given"), F.lit(1.0).alias("left"))
    levels, below = [], tops
    for d in range(top - 1, -1, -1):
        own = below.groupBy(F.col("node").bitwiseAND((1 << 8 * (d + 1)) - 1).alias("node")).agg(
            *(F.sum(c).alias(c) for c in ("zeros", "ones")), F.sum("weighted").alias("kids")).withColumn(
            "own", log_estimate(F.col("zeros"), F.col("ones"), F.log))
        more = F.greatest("own", "kids")
        mixed = more + F.log(F.exp(F.col("own") - more) + F.exp(F.col("kids") - more)) - math.log(2)
        below = folder.write(own.select("node", "zeros", "ones", mixed.alias("weighted"),
                                        (1 / (1 + F.exp(F.col("kids") - F.col("own")))).alias("stop")), f"level{d}")
        levels.append(below)
    one = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)
    down = None
    for d, level in enumerate(reversed(levels)):
        if down is None:
            rows = level.withColumn("given", F.lit(0.0)).withColumn("left", F.lit(1.0))
        else:
            rows = (level.withColumn("parent", F.col("node").bitwiseAND((1 << 8 * d) - 1))
                    .join(down.withColumnRenamed("node", "parent"), "parent"))
        down = rows.select("node", (F.col("given") + F.col("left") * F.col("stop") * one).alias("given"),
                           (F.col("left") * (1 - F.col("stop"))).alias("left"))
    return (tops.select("bucket", "node", F.col("node").bitwiseAND((1 << 8 * top) - 1).alias("parent"))
            .join(down.withColumnRenamed("node", "parent"), "parent").select("bucket", "node", "given", "left"))


def score(docs: DataFrame, held_out: Column, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text",
          buckets: int | None = None, chunk_bytes: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, bits_per_byte.

    ``score`` is the log10 probability of the text, ``bits_per_byte`` its code
    length by the byte (the end mark is a byte too); ``base_score`` that of
    its words one by one, each count one larger.  There are as many ``buckets``
    as shuffle partitions if not given; the result depends neither on them nor
    on ``chunk_bytes``.
    """
    if not 1 <= depth <= 6:
        raise ValueError("a run of depth + 1 bytes must fit a long: depth 1 to 6")
    spark = docs.sparkSession
    ship_package(spark)
    folder = SharedFolder(spark, "context-tree")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ready = folder.write(prepared(docs, held_out, depth, buckets, chunk_bytes, id_col, text_col), "chunks", "zstd")
    texts = ready.where("bucket IS NULL").select("chunk", "doc_id", "held_out", "n_tokens", "body")
    asked = ready.where("bucket IS NOT NULL").select("bucket", "chunk", "runs", "run_n", "words", "word_n")
    by_bucket = asked.drop("chunk").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    weighed = folder.write(by_bucket.mapInArrow(lambda batches: weigh(batches, depth), WEIGHED_SCHEMA), "weighed", "zstd")
    tops = weighed.where("node IS NOT NULL").select("bucket", "node", "zeros", "ones", "weighted")

    totals = weighed.where("node IS NULL")
    ends = texts.agg(F.count_if(~F.col("held_out")).alias("n")).first()["n"]
    told = totals.agg(F.sum("n_words").alias("n"), F.sum("n_distinct").alias("v")).first()
    total, distinct = (told["n"] or 0) + ends, (told["v"] or 0) + (ends > 0)
    per_token, end_value = math.log10(total + distinct + 1), math.log10(ends + 1)

    def of_kind(df: DataFrame, kind: int) -> DataFrame:
        columns = ("node", "long"), ("given", "double"), ("left", "double"), ("chunk", "long"), *((c, "binary") for c in ("runs", "run_n", "words", "word_n"))
        return df.select("bucket", F.lit(kind).alias("kind"), *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns))

    questions = (of_kind(upper_levels(tops, max(depth - INNER, 0), folder), 0)
                 .unionByName(of_kind(totals.select("bucket", "runs", "run_n", "words", "word_n"), 1))
                 .unionByName(of_kind(asked.select("bucket", "chunk", "runs", "words"), 2))
                 .repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind"))
    answers = questions.mapInArrow(lambda batches: answer(batches, depth), "of_chunk long, runs binary, logp binary, words binary, value binary")
    schema = (texts.select("doc_id", "held_out", "n_tokens").schema.add("n_known", "long").add("train_tokens", "long")
              .add("base_score", "double").add("score", "double").add("bits_per_byte", "double"))

    def score_chunk(mine: pa.Table, known: pa.Table) -> pa.Table:
        run = np.concatenate([unpacked(b.as_py()) for b in known.column("runs")])
        value = np.concatenate([np.frombuffer(released(b.as_py()), "<f8") for b in known.column("logp")])
        order = np.argsort(run)
        run, value = run[order], value[order]
        lookup: dict[bytes, float] = {}
        for words, values in zip(known.column("words"), known.column("value")):
            lookup.update(zip(released(words.as_py()).split(), np.frombuffer(released(values.as_py()), "<f8").tolist()))
        n = mine.num_rows
        got, base, seen, size = np.zeros(n), np.zeros(n), np.zeros(n, dtype=np.int64), np.zeros(n)
        parts: list[bytes] = []
        owner: list[int] = []

        def flush() -> None:
            number, place, sizes = runs(parts, depth)
            per = value[np.searchsorted(run, number)][place]
            np.add.at(got, owner, np.add.reduceat(per, np.concatenate([[0], np.cumsum(sizes)[:-1]])))
            parts.clear()
            owner.clear()

        waiting = 0
        for i, body in enumerate(mine.column("body")):
            body = body.as_py()
            words = body.split()
            values = np.fromiter(map(lookup.__getitem__, words), float, len(words))
            base[i] = values.sum() + end_value - (len(words) + 1) * per_token
            seen[i] = np.count_nonzero(values) + (ends > 0)
            size[i] = len(body) + 1
            for part in units(body, depth, PIECE):
                parts.append(part)
                owner.append(i)
                waiting += len(part)
                if waiting >= PIECE:
                    flush()
                    waiting = 0
        if parts:
            flush()
        return pa.table([mine.column("doc_id"), mine.column("held_out"), mine.column("n_tokens"), pa.array(seen, pa.int64()),
                         pa.array(np.full(n, total), pa.int64()), pa.array(base), pa.array(got),
                         pa.array(-got * math.log2(10) / size)], names=schema.names)

    return texts.groupBy("chunk").cogroup(answers.groupBy("of_chunk")).applyInArrow(score_chunk, schema)


def score_table(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Scores by a model of the documents outside the held-out fold of ids."""
    return score(docs, F.coalesce(fold("doc_id", 7) == 2, F.lit(False)), depth)
