"""Centroid clustering against every distance, and its edge cases."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from orderlens.llm import centroids
from orderlens.llm.centroids import Rule, VantageTree, cluster_table


def brute(rows, rule):
    """Plain Python: rows (vec_id, vector)."""
    kept = [(i, [math.floor(rule.scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == rule.dims and all(x is not None and math.isfinite(x) for x in v)]

    def key(row):
        return (row[0] is None, "" if row[0] is None else hashlib.sha256(f"{rule.seed}{row[0]}".encode()).hexdigest(), row[1])

    marks = [v for _, v in sorted(kept, key=key)[:rule.k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(marks)) for _, v in kept]

    for _ in range(rule.rounds):
        best = assign()
        for c in range(len(marks)):
            mine = [v for (_, v), (_, at) in zip(kept, best) if at == c]
            if mine:
                marks[c] = [sum(col) // len(mine) for col in zip(*mine)]
    best = assign()
    total = sum(d for d, _ in best)
    return sorted((str(i), c, d, sum(e for e, at in best if at == c), total,
                   hashlib.sha256(",".join(map(str, marks[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, best))


def result(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("spread", [2, 50, 100_000])
@pytest.mark.parametrize("k", [1, 3, 40, 200])
def test_the_tree_finds_the_nearest_point_with_ties(k, spread):
    rnd = np.random.default_rng(k + spread)
    points = rnd.integers(-spread, spread + 1, (k, 4))
    x = rnd.integers(-spread, spread + 1, (500, 4))
    d = ((x[:, None] - points[None]) ** 2).sum(axis=2)
    number, distance = VantageTree(points).nearest(x)
    assert (distance == d.min(axis=1)).all() and (number == d.argmin(axis=1)).all()


def test_the_tree_leaves_out_far_points():
    points = np.array([[1000 * i, 0] for i in range(64)])
    tree = VantageTree(points)
    seen = []
    tree.points = type("Counted", (np.ndarray,), {"__getitem__": lambda s, i: (seen.append(i), np.ndarray.__getitem__(s, i))[1]})(
        points.shape, dtype=np.int64, buffer=points.astype(np.int64).copy())
    number, _ = tree.nearest(np.array([[17_010, 0]]))
    assert number[0] == 17 and len(seen) < 40


def test_clusters_equal_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([-0.5, 0.0, 0.25, 0.3]) for _ in range(4)]) for i in range(300)]
    rows += [(None, [0.1] * 4), (7, [0.2] * 4), (7, rows[7][1]), (900, None), (901, [1.0]), (902, [float("nan")] * 4),
             (903, [1.0, None, 0.0, 0.0]), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [])]
    rule = Rule(k=7, rounds=3, dims=4)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, v int")
    assert result(cluster_table(df.repartition(5), rule)) == brute(rows, rule)


def test_fewer_rows_than_centroids_and_no_row(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    rule = Rule(k=5, rounds=2, dims=2)
    assert result(cluster_table(spark.createDataFrame(rows, schema), rule)) == brute(rows, rule)
    assert cluster_table(spark.createDataFrame([], schema), rule).count() == 0


def test_components_beyond_the_limit_count_as_the_limit(spark):
    df = spark.createDataFrame([(1, [1e30, -1e30]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in cluster_table(df, Rule(k=1, rounds=0, dims=2)).collect()}
    assert sorted(r.distance for r in got.values()) == [0, 2 * centroids.LIMIT ** 2]
