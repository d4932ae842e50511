"""Context-tree weighting against block probabilities worked out node by node, and its edge cases."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_edges import EDGES
from orderlens.llm import context_tree
from orderlens.llm.context_tree import Chunk, merged, normalised, runs, score, score_table, units


def estimate(zeros, ones):
    return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)


class Brute:
    """Block probabilities of the weighted trees; the next bit's is the ratio of two of them."""

    def __init__(self, bodies, depth):
        self.depth, self.counts, self.children = depth, Counter(), {}
        for body in bodies:
            for context, prefix, bit in self.decisions(body):
                for d in range(depth + 1):
                    self.counts[context[depth - d:], prefix, bit] += 1
                    if d:
                        self.children.setdefault((context[depth - d + 1:], prefix), set()).add(context[depth - d:])
        self.weighted = lru_cache(None)(self._weighted)

    def decisions(self, body):
        whole = b"\xff" * self.depth + body + b"\xff"
        for i in range(self.depth, len(whole)):
            prefix = 1
            for k in range(7, -1, -1):
                bit = whole[i] >> k & 1
                yield whole[i - self.depth:i], prefix, bit
                prefix = prefix << 1 | bit

    def _own(self, context, prefix, extra):
        n = [self.counts[context, prefix, b] + (extra == b) for b in (0, 1)]
        return estimate(*n)

    def _weighted(self, context, prefix):
        own = self._own(context, prefix, None)
        if len(context) == self.depth:
            return own
        kids = sum(self.weighted(c, prefix) for c in self.children.get((context, prefix), ()))
        return np.logaddexp(own, kids) - math.log(2)

    def after(self, context, prefix, bit, d=0):
        """The weighted probability at depth d when one more bit has come."""
        here = context[self.depth - d:]
        own = self._own(here, prefix, bit)
        if d == self.depth:
            return own
        path = context[self.depth - d - 1:]
        kids = sum(self.weighted(c, prefix) for c in self.children.get((here, prefix), ()) if c != path)
        return np.logaddexp(own, kids + self.after(context, prefix, bit, d + 1)) - math.log(2)

    def score(self, body):
        return sum(self.after(c, p, b) - self.weighted(b"", p) for c, p, b in self.decisions(body)) / math.log(10)


def expected(rows, depth):
    """rows (doc_id, text): the contract's columns by plain Python."""
    def held(i):
        return i is not None and zlib.crc32(str(i).encode()) % 7 == 2

    bodies = [(i, normalised((t or "").encode())) for i, t in rows]
    train = [b for i, b in bodies if not held(i)]
    words = Counter(w for b in train for w in b.split())
    ends = len(train)
    total, distinct = sum(words.values()) + ends, len(words) + (ends > 0)
    model = Brute(train, depth)
    out = []
    for i, b in bodies:
        counts = [words[w] for w in b.split()] + [ends]
        out.append((str(i), held(i), len(counts), sum(c > 0 for c in counts), total,
                    sum(math.log10((c + 1) / (total + distinct + 1)) for c in counts), model.score(b)))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect())


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], rel=1e-9, abs=1e-9)


ROWS = [(i, " ".join(random.Random(i).choices(["The", "the", "cat", "sat", "mat", "größe", "日本", "a"], k=i % 9))) for i in range(60)]
ROWS += [(None, "cat cat"), (3, "the cat"), (3, "the cat"), (100, None), (101, " \t\n"), (102, "x\x0b\x0cy")]


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_scores_equal_block_probabilities(spark, depth):
    df = spark.createDataFrame([(i, t, 0, "z") for i, t in ROWS], "doc_id long, text string, chunk int, held_out string").repartition(3)
    same(got(score_table(df, depth)), expected(ROWS, depth))


def test_chunks_and_buckets_do_not_change_the_scores(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(2)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    for chunk_bytes, buckets in ((1, 1), (40, 7), (1 << 20, 3)):
        same(got(score(df, held, 3, buckets=buckets, chunk_bytes=chunk_bytes)), expected(ROWS, 3))


def test_probabilities_of_the_next_byte_sum_to_one():
    model = Brute([b"abab cab", b"ab"], 2)

    def byte(context, value):
        prefix, total = 1, 0.0
        for k in range(7, -1, -1):
            total += model.after(context, prefix, value >> k & 1) - model.weighted(b"", prefix)
            prefix = prefix << 1 | (value >> k & 1)
        return math.exp(total)

    for context in (b"ab", b"zz", b"\xffa"):
        assert sum(byte(context, v) for v in range(256)) == pytest.approx(1)


def test_runs_of_pieces_equal_those_of_the_whole():
    rnd = random.Random(2)
    body = bytes(rnd.choices(b"abc d\xc3\xa9", k=5000))
    for depth in (1, 4, 6):
        whole = b"\xff" * depth + body + b"\xff"
        plain = Counter(int.from_bytes(whole[i:i + depth + 1], "big") for i in range(len(whole) - depth))
        for piece in (1, 7, 1000, 1 << 20):
            number, place, sizes = runs(list(units(body, depth, piece)), depth)
            assert dict(zip(number.tolist(), np.bincount(place).tolist())) == plain and sizes.sum() == len(body) + 1
        chunk = Chunk(0, depth, True)
        for i in range(0, 5000, 500):
            chunk.add(body[i:i + 500])
            chunk.fold()
        assert merged(chunk.found)[1].sum() == 5010


def test_ranks_by_sorting_equal_ranks_by_table(monkeypatch):
    parts = [bytes(random.Random(i).choices(range(256), k=300)) for i in range(5)]
    one = runs(parts, 3)
    monkeypatch.setattr(context_tree, "DENSE", 1)
    two = runs(parts, 3)
    assert dict(zip(one[0].tolist(), np.bincount(one[1]).tolist())) == dict(zip(two[0].tolist(), np.bincount(two[1]).tolist()))
    assert (one[0][one[1]] == two[0][two[1]]).all()


def test_edges_and_empty_tables(spark, docs):
    same(got(score_table(docs(EDGES[:-2]), 2)), expected([r[:2] for r in EDGES[:-2]], 2))
    full = score_table(docs(EDGES)).collect()
    assert len(full) == len(EDGES) and all(math.isfinite(r.score) and r.bits_per_byte > 0 for r in full)
    assert score_table(docs([])).count() == 0
    only_held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(i, "ab c", None, None) for i in only_held]
    same(got(score_table(docs(rows), 2)), expected([r[:2] for r in rows], 2))


def test_held_out_texts_of_the_corpus_are_more_likely_than_scrambled_ones(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    out = score_table(rows).agg(F.avg("bits_per_byte").alias("b")).first()["b"]
    assert 1 < out < 4
