"""MinHash near-dedup with odd sketches.

Every text becomes a set of word shingles and ``SAMPLES`` MinHash values; equal
sets are one class from then on.  The values serve twice: in bands, whose keys
bring similar classes together, and folded into a parity bitmap (an odd
sketch).  The number of ones in the XOR of two bitmaps estimates a high
similarity precisely, so most candidates are dismissed from 64 bytes; the rest
are confirmed on the full sets.

A bucket of a band never emits its pairs.  Its members are first compared with
its hub, the one whose buckets are the fullest (in a group of edited copies,
the original); what is confirmed joins a component.  Only buckets that then
hold more than one component are searched again, and there only members
outside the hub's component are compared with the others, since pairs within a
component cannot change the result.  In crowded buckets each member also carries
how its set differs from the hub's; two members' differences bound what they
can share, so that edited copies of one text that are too far from each other
are told apart without their sets.

Band sizes are chosen so that a pair at the threshold shares no band with a
probability below ``MISS``; the sketch dismisses a pair only five standard
deviations below the threshold.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import SharedFolder, bound_batches, keep_only, resting, ship_package

SAMPLES = 240
SKETCH_BITS = 512
MISS = 1e-8
#: Ids (8 bytes each) that are broadcast to pick texts; a larger set is joined by key.
BROADCAST_IDS = 500_000
#: Members above which a bucket's members carry their differences from its hub;
#: each difference is kept as the places of its shingles among PLACES.
CROWD, PLACES = 32, 1024
#: Bytes of text hashed at once (a worker's tables hold 16 bytes for each), shingles hashed at once.
PIECE_BYTES, PIECE_SHINGLES = 1 << 17, 1 << 10

_U = np.uint64


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; linked where ``percent`` of the union is shared."""

    words: int = 5
    percent: int = 80

    @property
    def rows(self) -> int:
        t = self.percent / 100
        return max(r for r in range(1, 13) if (1 - t**r) ** (SAMPLES // r) <= MISS or r == 1)

    @property
    def bands(self) -> int:
        return SAMPLES // self.rows

    @property
    def most_different_bits(self) -> int:
        """Ones in the XOR of two sketches that a linked pair stays within."""
        t, n, k = self.percent / 100, SKETCH_BITS, SAMPLES
        toggles = 2 * k * (1 - t)
        kept = math.exp(-2 * toggles / n)
        share = (1 - kept) / 2
        # of a fixed number of toggles on n bits
        spread = n * share * (1 - share) - toggles * kept**2
        sketch_error = math.sqrt(spread) / kept / (2 * k)
        least = t - 5 * math.hypot(math.sqrt(t * (1 - t) / k), sketch_error)
        return math.ceil(n * (1 - math.exp(-4 * k * (1 - least) / n)) / 2)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte codes (capitals as small letters), white space, powers of the base and their inverses."""
    rng = np.random.default_rng(20_240)
    codes = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    codes[65:91] = codes[97:123]
    space = np.zeros(256, dtype=bool)
    space[[32, *range(9, 14)]] = True
    base = int(rng.integers(1, 1 << 62)) * 2 + 1
    up = np.full(PIECE_BYTES, base, dtype=np.uint64)
    down = np.full(PIECE_BYTES, pow(base, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return codes, space, np.cumprod(up), np.cumprod(down)


@lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    return np.random.default_rng(7).integers(1 << 32, 1 << 63, SAMPLES, dtype=np.uint64) * _U(2) + _U(1)


def _forget() -> None:
    _tables.cache_clear()
    _multipliers.cache_clear()


def _word_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words of a piece of at most PIECE_BYTES bytes, or of one longer word."""
    codes, space, up, down = _tables()
    solid = ~space[raw]
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(raw) > PIECE_BYTES:  # a single word
        total = _U(0)
        for at in range(0, len(raw), PIECE_BYTES):
            part = codes[raw[at:at + PIECE_BYTES]]
            total = _mix(np.array([total + (part * up[: len(part)]).sum(dtype=np.uint64)]))[0]
        return _mix(np.array([total ^ _U(len(raw))]))
    sums = np.concatenate([[_U(0)], np.cumsum(codes[raw] * up[: len(raw)], dtype=np.uint64)])
    return _mix((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64)) if len(starts) else \
        np.zeros(0, np.uint64)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of all words of a text, read piece by piece; a piece ends at white space."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if len(raw) <= PIECE_BYTES:
        return _word_hashes(raw)
    space = _tables()[1]
    parts, at = [], 0
    while at < len(raw):
        stop = at + PIECE_BYTES
        if stop < len(raw):
            back = np.flatnonzero(space[raw[at:stop]])
            if len(back):
                stop = at + int(back[-1]) + 1
            else:  # a word longer than a piece: up to the next white space
                while stop < len(raw) and not space[raw[stop:stop + PIECE_BYTES]].any():
                    stop += PIECE_BYTES
                if stop < len(raw):
                    stop += int(np.flatnonzero(space[raw[stop:stop + PIECE_BYTES]])[0])
        parts.append(_word_hashes(raw[at:min(stop, len(raw))]))
        at = stop
    return np.concatenate(parts)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text with fewer words has one, an empty one none."""
    h = word_hashes(text or "")
    if not len(h):
        return h
    size = min(words, len(h))
    out = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + h[i:len(h) - size + 1 + i])
    return np.unique(out)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    best = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    factors = _multipliers()[:, None]
    for at in range(0, len(shingles), PIECE_SHINGLES):
        np.minimum(best, (factors * shingles[at:at + PIECE_SHINGLES]).min(axis=1), out=best)
    return best


def band_keys(samples: np.ndarray, rule: Rule) -> np.ndarray:
    grid = samples[: rule.bands * rule.rows].reshape(rule.bands, rule.rows)
    key = np.arange(1, rule.bands + 1, dtype=np.uint64)
    for r in range(rule.rows):
        key = _mix(key * _U(0x9E3779B97F4A7C15) + grid[:, r])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity of the samples that fall on each bit, as 64-bit numbers."""
    bit = _mix(samples + np.arange(1, SAMPLES + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)) % _U(SKETCH_BITS)
    parity = (np.bincount(bit.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def sketches(docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, set_id, keys, odd)`` of every row; ``set_id`` is a 128-bit digest of the full set."""
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_id", pa.binary()),
                        ("keys", pa.list_(pa.int64())), ("odd", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("near_dedup", _forget)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                ids = batch.column(0)[first:first + 256]
                n, digest, keys, odd = [], [], [], []
                for text in batch.column(1)[first:first + 256]:
                    own = shingle_set(text.as_py(), rule.words)
                    n.append(len(own))
                    if not len(own):
                        digest.append(None), keys.append(None), odd.append(None)
                        continue
                    samples = min_hashes(own)
                    digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    keys.append(band_keys(samples, rule))
                    odd.append(odd_sketch(samples))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(v, t) for v, t in zip((n, digest, keys, odd), schema.types[1:]))], schema.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        resting(run), "doc_id long, n long, set_id binary, keys array<long>, odd array<long>")


def shingle_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """``(cid, shingles)`` of rows ``(cid, text)``."""
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("near_dedup", _forget)
        for batch in batches:
            for i in range(batch.num_rows):
                own = shingle_set(batch.column(1)[i].as_py(), rule.words).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:i + 1], pa.array([own], pa.list_(pa.int64()))],
                                                 ["cid", "shingles"])

    return docs.select("cid", "text").mapInArrow(resting(run), "cid long, shingles array<long>")


def components(edges: DataFrame, folder: SharedFolder, label: str) -> DataFrame:
    """``(cid, comp)`` of every node of ``edges(a, b)``: the smallest node it reaches.

    Every round maps a node to its smallest neighbour or itself and replaces
    the ends of the edges by their images, until no edge is left.
    """
    edges = folder.write(edges.select("a", "b").where("a <> b").distinct(), f"{label}-edges0")
    nodes = edges.select("a").union(edges.select("b")).distinct()
    labels = folder.write(nodes.select(F.col("a").alias("cid"), F.col("a").alias("comp")), f"{label}-labels0")
    turn = 0
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = folder.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("to")),
                            f"{label}-step{turn}")
        turn += 1
        moved = (labels.join(step, labels["comp"] == step["node"], "left")
                 .select("cid", F.coalesce("to", "comp").alias("comp")))
        labels = folder.write(moved, f"{label}-labels{turn}")
        ends = edges.join(step, edges["a"] == step["node"]).select(F.col("to").alias("a"), "b")
        ends = ends.join(step, ends["b"] == step["node"]).select("a", F.col("to").alias("b"))
        edges = folder.write(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                             .distinct(), f"{label}-edges{turn}")
    return labels


def _sizes_allow(n_a: Column, n_b: Column, rule: Rule) -> Column:
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * rule.percent


def _sketches_allow(odd_a: Column, odd_b: Column, rule: Rule) -> Column:
    words = SKETCH_BITS // 64
    different = reduce(add, [F.bit_count(odd_a[i].bitwiseXOR(odd_b[i])) for i in range(words)])
    return different <= rule.most_different_bits


def _places(shingles: Column) -> Column:
    return F.array_distinct(F.transform(shingles, lambda h: F.pmod(h, F.lit(PLACES)).cast("int")))


def _differences_allow(rule: Rule) -> Column:
    """Whether members x and y of a bucket can be linked, by their differences
    from its hub: of the hub's shingles they cannot share those at the places
    that one of them lacks, and of those that the hub lacks they share at most
    the places in common and the shingles that fall on a place already taken."""
    most = (F.col("hx") - F.size(F.array_union("lx", "ly")) + F.size(F.array_intersect("ax", "ay"))
            + F.least("sx", "sy"))
    return F.col("hx").isNull() | F.col("hy").isNull() | (
        most * 100 >= (F.col("nx") + F.col("ny") - most) * rule.percent)


class NearDuplicates:
    """Links of equal or similar texts and their components."""

    def __init__(self, docs: DataFrame, rule: Rule, id_col: str = "doc_id", text_col: str = "text"):
        self.rule, self.folder = rule, SharedFolder(docs.sparkSession, "near")
        self.docs = docs.select(F.col(id_col).cast("long").alias("cid"), F.col(text_col).alias("text"))
        self.rows = self.folder.write(sketches(docs, rule, id_col, text_col), "sketches")
        first = self.rows.where("set_id IS NOT NULL").groupBy("set_id").agg(
            F.min("doc_id").alias("cid"), F.first("n").alias("n"), F.first("keys").alias("keys"),
            F.first("odd").alias("odd"))
        self.classes = self.folder.write(first.where("cid IS NOT NULL"), "classes")

    def _sets(self, pairs: DataFrame, label: str) -> DataFrame:
        """``(cid, shingles)`` of all ids in the two columns of ``pairs``."""
        one, two = pairs.columns
        needed = pairs.select(F.col(one).alias("cid")).union(pairs.select(two)).distinct()
        needed = self.folder.write(needed, f"{label}-needed")
        few = needed.count() <= BROADCAST_IDS
        texts = self.docs.join(F.broadcast(needed) if few else needed, "cid", "left_semi")
        return self.folder.write(shingle_sets(texts, self.rule), f"{label}-sets")

    def _differences(self, pairs: DataFrame) -> DataFrame:
        """How the sets of ``pairs(cid, hub)`` differ: the hub's size, the places
        of what the member lacks and has besides, and the shingles besides that
        share a place."""
        pairs = self.folder.write(pairs, "crowd-pairs")
        sets = self._sets(pairs, "crowd")
        one = sets.select("cid", F.col("shingles").alias("own"))
        two = sets.select(F.col("cid").alias("hub"), F.col("shingles").alias("of_hub"))
        both = pairs.join(one, "cid").join(two, "hub").select(
            "cid", "hub", F.size("of_hub").alias("hub_n"), _places(F.array_except("of_hub", "own")).alias("lacks"),
            F.array_except("own", "of_hub").alias("besides"))
        out = self.folder.write(both.select("cid", "hub", "hub_n", "lacks", _places(F.col("besides")).alias("adds"),
                                            (F.size("besides") - F.size(_places(F.col("besides")))).alias("spare")),
                                "crowd-differences")
        self.folder.drop("crowd-sets")
        return out

    def _confirmed(self, pairs: DataFrame, label: str) -> DataFrame:
        """The pairs ``(a, b)`` whose full sets are similar enough."""
        pairs = self.folder.write(pairs, f"{label}-pairs")
        sets = self._sets(pairs, label)
        one = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
        two = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
        shared = F.size(F.array_intersect("sa", "sb"))
        linked = shared * 100 >= (F.size("sa") + F.size("sb") - shared) * self.rule.percent
        out = self.folder.write(pairs.join(one, "a").join(two, "b").where(linked).select("a", "b"), f"{label}-links")
        self.folder.drop(f"{label}-sets")
        return out

    def _described(self, pairs: DataFrame) -> DataFrame:
        """Pairs that sizes and sketches do not rule out."""
        of = self.classes.select("cid", "n", "odd")
        a = of.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa"))
        b = of.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob"))
        both = pairs.join(a, "a").join(b, "b")
        return both.where(_sizes_allow(F.col("na"), F.col("nb"), self.rule)
                          & _sketches_allow(F.col("oa"), F.col("ob"), self.rule)).select("a", "b").distinct()

    def links(self) -> DataFrame:
        """Confirmed pairs of classes that connect all similar ones."""
        keyed = self.classes.select(F.explode("keys").alias("key"), "cid")
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        keyed = self.folder.write(keyed.join(sizes, "key"), "buckets")
        degree = keyed.groupBy("cid").agg(F.sum("size").alias("degree"))
        ranked = keyed.join(degree, "cid").select("key", "cid", F.struct("degree", "cid").alias("rank"))
        hubs = self.folder.write(ranked.groupBy("key").agg(F.max("rank").alias("rank"))
                                 .select("key", F.col("rank.cid").alias("hub")), "hubs")
        stars = keyed.select("key", "cid").join(hubs, "key").where("cid <> hub")
        stars = stars.select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct()
        first = self._confirmed(self._described(stars), "star")
        found = components(first, self.folder, "star")
        members = keyed.join(found, "cid", "left").select("key", "cid", "size", F.coalesce("comp", "cid").alias("comp"))
        spread = members.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
        mains = (spread.join(hubs, "key").join(found.withColumnRenamed("cid", "hub"), "hub", "left")
                 .select("key", "hub", F.coalesce("comp", "hub").alias("main")))
        members = self.folder.write(members.join(mains, "key"), "open-members")
        differences = self._differences(members.where(F.col("size") > CROWD).select("cid", "hub").distinct())
        members = members.join(self.classes.select("cid", "n", "odd", "keys"), "cid")
        members = self.folder.write(members.join(differences, ["cid", "hub"], "left"), "open")

        def side(rows: DataFrame, of: str, *more: Column) -> DataFrame:
            short = {"cid": of, "comp": "c" + of, "n": "n" + of, "odd": "o" + of, "keys": "k" + of, "hub_n": "h" + of,
                     "lacks": "l" + of, "adds": "a" + of, "spare": "s" + of}
            return rows.select("key", *(F.col(name).alias(to) for name, to in short.items()), *more)

        x = side(members.where("comp <> main"), "x")
        y = side(members, "y", (F.col("comp") == F.col("main")).alias("home"))
        # the join's own condition holds the tests: a pair that fails them is never
        # emitted, any other once, in the first of the buckets that it shares (all
        # of them are open, as its ends are of two components)
        across = x.join(y, (x["key"] == y["key"]) & (F.col("cx") != F.col("cy"))
                        & (F.col("home") | (F.col("x") < F.col("y")))
                        & _sizes_allow(F.col("nx"), F.col("ny"), self.rule)
                        & _sketches_allow(F.col("ox"), F.col("oy"), self.rule)
                        & (F.element_at(F.array_intersect("kx", "ky"), 1) == x["key"])
                        & _differences_allow(self.rule))
        across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        return first.union(self._confirmed(across, "rest"))

    def table(self) -> DataFrame:
        """One row per row of the input: doc_id, n_shingles, component_id, kept.

        A text without words links with nothing.  Rows that share an id are
        one document; rows with a null id link with nothing and stay.
        """
        found = components(self.links(), self.folder, "all")
        comp = (self.classes.select("set_id", "cid").join(found, "cid", "left")
                .select("set_id", F.coalesce("comp", "cid").alias("comp")))
        out = self.rows.select("doc_id", "n", "set_id").join(comp, "set_id", "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
        return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                          F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicate_table(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    return NearDuplicates(docs, rule).table()


def drop_near_copies(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose component has a smaller id."""
    table = NearDuplicates(docs, rule, id_col, text_col).table()
    gone = table.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
