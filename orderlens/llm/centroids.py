"""Centroid clustering in whole numbers, with a vantage-point tree of the centroids.

Vectors become integers, so every distance, sum and mean is exact and a rerun
gives the same clusters on any number of executors.  Each round builds a
vantage-point tree over the centroids and broadcasts it: at most ``k`` vectors
of ``dims`` numbers, whatever the size of the table.  A vector's search is
best first: it takes the node with the smallest lower bound next and stops when
that bound exceeds the nearest distance found.  The bound is inclusive, so
centroids that are equally far are all seen and the smallest number wins.  A
batch of vectors searches in step; each has its own queue of nodes.

A task adds up its vectors per cluster and hands on ``k * (dims + 1)`` sums;
these are added up in the cluster, and as many numbers reach the driver.
Nothing else leaves the tasks before the last assignment.

Rows that take no part: vector null, of another length than ``dims``, or with a
null or non-finite component.  An integer beyond ``LIMIT`` (a component of
524,288 at the default scale) counts as ``LIMIT``, so that distances fit a
long.  A null id is kept; in the choice of the first centroids it comes last.
Rows that share an id are rows of their own, and of rows that share an id and
hash the smaller vector comes first.  With fewer than ``k`` rows every row
starts a cluster; an empty table gives an empty result.  Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import SharedFolder, ship_package

LIMIT = 1 << 27
#: Centroids of a leaf, vectors that search in step.
LEAF, BATCH = 4, 2048
#: Bounds are sums of rounded roots; a node is left out only beyond this relative slack.
SLACK = 1e-9


@dataclass(frozen=True)
class Rule:
    """``k`` centroids, ``rounds`` of moving them, components ``floor(scale * x)``."""

    k: int = 40
    rounds: int = 5
    dims: int = 64
    scale: float = 256.0
    seed: str = "2:"


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    diff = x - y
    return np.einsum("ij,ij->i", diff, diff)


class VantageTree:
    """A vantage-point tree over numbered integer points.

    An inner node holds a vantage point and two halves, those up to the median
    distance from it and the rest, each with the range of its distances.
    """

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.int64)
        self.nodes: list[tuple] = []
        if len(points):
            self._build(np.arange(len(points)))

    def _build(self, members: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if len(members) <= LEAF:
            self.nodes[at] = ("leaf", members)
            return at
        vantage, rest = members[0], members[1:]
        away = np.sqrt(squared(self.points[rest], self.points[vantage][None, :]).astype(np.float64))
        order = np.argsort(away, kind="stable")
        half = len(rest) // 2
        halves = []
        for part in (order[:half], order[half:]):
            halves.append((away[part].min(), away[part].max(), self._build(rest[part])))
        self.nodes[at] = ("split", vantage, halves)
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each row's nearest point; of equally near ones the smallest number."""
        n = len(x)
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.points), dtype=np.int64)
        queue = np.full((n, len(self.nodes)), np.inf)
        queue[:, 0] = 0.0

        def offer(rows: np.ndarray, point: int) -> np.ndarray:
            d = squared(x[rows], self.points[point][None, :])
            nearer = (d < best[rows]) | ((d == best[rows]) & (point < number[rows]))
            best[rows[nearer]], number[rows[nearer]] = d[nearer], point
            return d

        searching = np.arange(n)
        while len(searching):
            node = queue[searching].argmin(axis=1)
            bound = queue[searching, node]
            going = bound <= np.sqrt(best[searching].astype(np.float64)) * (1 + SLACK)  # inclusive: equal distances are seen
            searching, node, bound = searching[going], node[going], bound[going]
            for one in np.unique(node):
                here = node == one
                rows = searching[here]
                queue[rows, one] = np.inf
                kind, *rest = self.nodes[one]
                if kind == "leaf":
                    for point in rest[0]:
                        offer(rows, int(point))
                    continue
                vantage, halves = rest
                away = np.sqrt(offer(rows, int(vantage)).astype(np.float64))
                for least, most, child in halves:
                    gap = np.maximum(away - most, least - away) - SLACK * (away + most)
                    queue[rows, child] = np.maximum(np.maximum(gap, bound[here]), 0.0)
            # a row whose queue is empty has an infinite bound and ends
            searching = searching[np.isfinite(queue[searching].min(axis=1))] if len(searching) else searching
        return number, best


def kept(rows: DataFrame, rule: Rule, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, v)``: the rows that take part, components as double."""
    v = F.col(f"`{vector_col}`").cast("array<double>")

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return (rows.select(F.col(f"`{id_col}`").alias("vec_id"), v.alias("v"))
            .where((F.size("v") == rule.dims) & F.coalesce(F.forall("v", finite), F.lit(False))))


def integers(batch: pa.RecordBatch, rule: Rule) -> np.ndarray:
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    whole = np.clip(np.floor(rule.scale * flat), -LIMIT, LIMIT).astype(np.int64)
    return whole.reshape(batch.num_rows, rule.dims)


def first_centroids(vectors: DataFrame, rule: Rule) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of the seed and their id."""
    name = F.sha2(F.concat(F.lit(rule.seed), F.col("vec_id").cast("string")), 256)
    whole = F.transform("v", lambda x: F.greatest(F.least(F.floor(x * F.lit(rule.scale)), F.lit(LIMIT)), F.lit(-LIMIT)))
    top = vectors.select(name.alias("h"), whole.alias("w")).orderBy(F.col("h").asc_nulls_last(), "w").limit(rule.k)
    return np.array([list(r["w"]) for r in top.collect()], dtype=np.int64).reshape(-1, rule.dims)


def moved(vectors: DataFrame, centroids: np.ndarray, rule: Rule) -> np.ndarray:
    """The centroids after one round; an empty one stays where it is."""
    shared = vectors.sparkSession.sparkContext.broadcast(VantageTree(centroids))
    dims = rule.dims

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        sums = np.zeros((len(tree.points), dims + 1), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                x = integers(batch.slice(at, BATCH), rule)
                number, _ = tree.nearest(x)
                for one in np.unique(number):
                    mine = x[number == one]
                    sums[one, :dims] += mine.sum(axis=0)
                    sums[one, dims] += len(mine)
        cluster, place = np.nonzero(np.repeat(sums[:, dims:] > 0, dims + 1, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(place, pa.int32()),
                                          pa.array(sums[cluster, place], pa.int64())], ["cluster", "place", "total"])

    parts = vectors.mapInArrow(add_up, "cluster int, place int, total long")
    sums = np.zeros((len(centroids), dims + 1), dtype=np.int64)
    for r in parts.groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect():  # k * (dims + 1) at most
        sums[r["cluster"], r["place"]] = r["total"]
    shared.unpersist()
    filled = sums[:, dims] > 0
    out = centroids.copy()
    out[filled] = sums[filled, :dims] // sums[filled, dims:]  # floor, below zero too
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray, rule: Rule) -> DataFrame:
    """``(vec_id, cluster, distance)``: each vector's nearest centroid and the squared distance to it."""
    shared = vectors.sparkSession.sparkContext.broadcast(VantageTree(centroids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                number, distance = tree.nearest(integers(part, rule))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())],
                                                 ["vec_id", "cluster", "distance"])

    schema = vectors.select("vec_id").schema.add("cluster", "integer").add("distance", "long")
    return vectors.mapInArrow(assign, schema)


def fit(vectors: DataFrame, rule: Rule) -> np.ndarray:
    centroids = first_centroids(vectors, rule)
    if len(centroids):
        for _ in range(rule.rounds):
            centroids = moved(vectors, centroids, rule)
    return centroids


def cluster_table(rows: DataFrame, rule: Rule = Rule(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = rows.sparkSession
    ship_package(spark)
    vectors = kept(rows, rule, id_col, vector_col)
    centroids = fit(vectors, rule)
    out = SharedFolder(spark, "centroids").write(assigned(vectors, centroids, rule), "assigned")
    # one row per cluster, k at most
    sums = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    told = [(i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
            for i, c in enumerate(centroids)]
    clusters = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (out.join(F.broadcast(clusters), "cluster")
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))


def oracle(rule: Rule = Rule()) -> str:
    """The same clusters as DuckDB SQL over ``embeddings``: every round compares every vector with every centroid."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({rule.scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {rule.dims}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {rule.dims}),
named AS (SELECT v, row_number() OVER (ORDER BY sha256('{rule.seed}' || vec_id) NULLS LAST, v) - 1 AS c FROM kept),
c0 AS MATERIALIZED (SELECT c, v FROM named WHERE c < {rule.k})"""]
    for i in range(rule.rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT k.n, any_value(k.vec_id) AS vec_id, any_value(k.v) AS v,
         min({{'d': list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': c.c}}) AS best
  FROM kept k CROSS JOIN c{i} c GROUP BY k.n)""")
        if i < rule.rounds:
            steps.append(f"""
s{i} AS (SELECT best.c AS c, place, sum(x)::BIGINT AS s, count(*) AS n
         FROM (SELECT best, unnest(v) AS x, unnest(range({rule.dims})) AS place FROM a{i}) GROUP BY 1, 2),
m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY place) AS v FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.c = c.c)""")
    last = rule.rounds
    return f"""WITH {','.join(steps)}
SELECT a.vec_id, a.best.c::INTEGER AS cluster, a.best.d AS distance,
       sum(a.best.d) OVER (PARTITION BY a.best.c)::BIGINT AS cluster_inertia, sum(a.best.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{last} a JOIN c{last} c ON c.c = a.best.c"""
