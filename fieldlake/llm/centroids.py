"""Operator 13: clustering by exact integer centroids, assigned through a vantage-point tree.

Vectors become integers once, in a written table.  Each round builds a vantage-point
tree over the centroids on the driver and broadcasts it: its size is set by the
parameters ``size`` and ``dimensions``.  Tasks walk the tree for every vector best
first, by the least distance that the triangle inequality leaves to a node, and a
node is passed over only if that bound is greater than the best distance so far, so
a centroid at the very same distance is always seen.  Distances that decide are exact
integers, and of equally near centroids the smaller number wins; square roots only
ever prune, with a margin above their rounding.

A task adds up its vectors by cluster, so a round shuffles one row per task and
cluster, and the driver reads one row per cluster.  Equal vectors and crowded clusters
need no care: no row is dealt by its cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.neighbours import matrix
from fieldlake.llm.staging import bounded_batches, stage

LEAF = 4
LARGEST = 1 << 27
"""Components beyond this have squared distances that a long cannot hold."""
MARGIN = 1e-9


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to one point."""
    gap = rows - point
    return np.einsum("ij,ij->i", gap, gap)


@dataclass
class Node:
    """A leaf holds centroid numbers; an inner node has a vantage point and children with their range of distances to it."""

    numbers: list[int] = field(default_factory=list)
    vantage: int = -1
    children: list[tuple[int, float, float]] = field(default_factory=list)


class VantageTree:
    """Nodes over the centroids, halved by their distance to a vantage point; equal distances may stand on both sides."""

    def __init__(self, centroids: np.ndarray, leaf: int = LEAF):
        self.centroids, self.leaf, self.nodes = centroids, leaf, []
        self._build(np.arange(len(centroids)))

    def _build(self, numbers: np.ndarray) -> int:
        name = len(self.nodes)
        self.nodes.append(node := Node())
        if len(numbers) <= self.leaf:
            node.numbers = numbers.tolist()
            return name
        # the centroid farthest from the middle sees the others at the most varied distances
        middle = self.centroids[numbers].mean(axis=0)
        chosen = int(np.argmax(((self.centroids[numbers] - middle) ** 2).sum(axis=1)))
        node.vantage, rest = int(numbers[chosen]), np.delete(numbers, chosen)
        distance = np.sqrt(squared(self.centroids[rest], self.centroids[node.vantage]).astype(np.float64))
        order = np.argsort(distance, kind="stable")
        for part in np.array_split(order, 2):
            if len(part):
                node.children.append((self._build(rest[part]), float(distance[part[0]]), float(distance[part[-1]])))
        return name

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and exact squared distance of the nearest centroid of every row; all rows walk at once, each in its own order."""
        count = len(rows)
        number = np.full(count, len(self.centroids), dtype=np.int64)
        best = np.full(count, np.iinfo(np.int64).max, dtype=np.int64)
        bounds = np.full((count, len(self.nodes)), np.inf)  # of nodes that are open; others are infinite
        bounds[:, 0] = 0.0
        active = np.arange(count)
        while len(active):
            node = bounds[active].argmin(axis=1)
            bound = bounds[active, node]
            reach = np.sqrt(best[active].astype(np.float64))
            go = np.isfinite(bound) & (bound <= reach + MARGIN * (1 + reach + bound))  # equal bounds are followed
            active, node = active[go], node[go]
            for name in np.unique(node).tolist():
                at = active[node == name]
                low = bounds[at, name].copy()
                bounds[at, name] = np.inf
                here, these = self.nodes[name], rows[at]
                for centroid in here.numbers:
                    self._offer(number, best, at, centroid, squared(these, self.centroids[centroid]))
                if here.children:
                    distance = squared(these, self.centroids[here.vantage])
                    self._offer(number, best, at, here.vantage, distance)
                    distance = np.sqrt(distance.astype(np.float64))
                    for child, near, far in here.children:
                        bounds[at, child] = np.maximum(low, np.maximum(near - distance, distance - far))
        return number, best

    @staticmethod
    def _offer(number: np.ndarray, best: np.ndarray, at: np.ndarray, centroid: int, distance: np.ndarray) -> None:
        better = (distance < best[at]) | (distance == best[at]) & (centroid < number[at])
        number[at[better]], best[at[better]] = centroid, distance[better]


def integers(df: DataFrame, dimensions: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id long, vector array<long>`` of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("real"))
    scaled = F.transform("real", lambda x: F.floor(x * F.lit(float(scale))))
    usable = F.forall("real", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= F.lit(LARGEST / scale)), F.lit(False)))
    return rows.where((F.size("real") == dimensions) & usable).select("vec_id", scaled.cast("array<long>").alias("vector"))


def first_centroids(rows: DataFrame, size: int, seed: int) -> np.ndarray:
    """The vectors whose id hashes lowest; ``size`` rows reach the driver."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.orderBy(rank.asc_nulls_last(), "vector").limit(size).select("vector").collect()
    return np.array([r.vector for r in chosen], dtype=np.int64)


def _sums(tree: Broadcast[VantageTree], dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(tree.value.centroids)
        count, sums = np.zeros(size, dtype=np.int64), np.zeros((size, dimensions), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                rows = matrix(batch.column("vector"))
                number, _ = tree.value.nearest(rows)
                count += np.bincount(number, minlength=size)
                np.add.at(sums, number, rows)
        used = np.flatnonzero(count)
        columns = [used, count[used], *sums[used].T]
        yield pa.record_batch([pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns], names=["cluster", "n", *(f"s{i}" for i in range(dimensions))])

    return run


def next_centroids(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact floors of the mean of every cluster; an empty cluster keeps its centroid."""
    dimensions = centroids.shape[1]
    tree = rows.sparkSession.sparkContext.broadcast(VantageTree(centroids))
    names = ["n", *(f"s{i}" for i in range(dimensions))]
    partial = rows.mapInArrow(_sums(tree, dimensions), "cluster long, " + ", ".join(f"{c} long" for c in names))
    totals = partial.groupBy("cluster").agg(*(F.sum(c).alias(c) for c in names)).collect()  # a row per cluster
    out = centroids.copy()
    for r in totals:
        out[r.cluster] = [r[c] // r.n for c in names[1:]]
    return out


RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"


def cluster(df: DataFrame, size: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Cluster of every vector after ``rounds`` rounds of assignment and integer means, and one last assignment.

    Returns ``vec_id long, cluster int, distance long`` (squared), ``cluster_inertia
    long, inertia long, centroid array<long>``, a row per vector that takes part: those
    with exactly ``dimensions`` components, none null or non-finite.  A component that
    leaves ``LARGEST`` after scaling has no squared distance in a long, so its row takes
    no part either.  Repeated rows are vectors of their own; equal ids start in the order
    of their vectors; a null id takes part but starts last.  With fewer than ``size``
    vectors each is a first centroid.  Other columns are not looked at.  Without a
    usable row the result is empty.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows = stage(integers(df, dimensions, scale, id_col, vector_col), "centroids-vectors")
    centroids = first_centroids(rows, size, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    for _ in range(rounds):
        centroids = next_centroids(rows, centroids)
    tree = spark.sparkContext.broadcast(VantageTree(centroids))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, best = tree.value.nearest(matrix(batch.column("vector")))
                yield pa.record_batch([batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(best)], names=["vec_id", "cluster", "distance"])

    placed = stage(rows.mapInArrow(assign, "vec_id long, cluster int, distance long"), "centroids-placed")
    totals = {r.cluster: r.total for r in placed.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    kept = [(c, t, sum(totals.values()), centroids[c].tolist()) for c, t in sorted(totals.items())]
    table = spark.createDataFrame(kept, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    # one row per cluster, ``size`` at most
    return placed.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
