"""Centroid clustering with a vantage-point tree over the centroids.

A round broadcasts a tree over the k centroids, built by the driver from k
vectors.  Tasks search it for every vector: best-first branch-and-bound, each
vector with bounds of its own on the nodes that it has yet to visit, a batch
of vectors in step.  A node is visited while its bound isn't above the best
distance so far, equal ones too, so that ties go to the smaller number;
distances are exact integers.  Tasks return sums and counts of their clusters,
k rows each, and the driver gets k rows a round.

Edge cases: vectors that are null, of another length, or hold null or
non-finite components take no part; a null id takes part but seeds come from
it last; fewer vectors than k give as many centroids; repeated rows count
each; an empty table gives an empty result; other columns aren't read.
Distances that could exceed a long are an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .topk import quantised, valid

K, ROUNDS, DIM, SEED = 40, 5, 64, "2"
#: Centroids that a leaf of the tree holds, and vectors searched in step.
LEAF, TOGETHER = 4, 4_096
FAR = np.iinfo(np.int64).max


class Tree:
    """A vantage-point tree: arrays of nodes; a leaf has points, any other node a vantage point and two children with the range of their distances from it."""

    def __init__(self, centroids: np.ndarray, leaf: int = LEAF):
        self.centroids = np.asarray(centroids, np.int64)
        self.squares = (self.centroids**2).sum(axis=1)
        self.points: list[np.ndarray] = []
        self.children: list[list[tuple[int, float, float]]] = []
        if len(self.centroids):
            self._add(np.arange(len(self.centroids)), leaf)

    def _add(self, numbers: np.ndarray, leaf: int) -> int:
        at = len(self.points)
        self.points.append(np.sort(numbers))
        self.children.append([])
        if len(numbers) <= leaf:
            return at
        squared = self.distances(self.centroids[numbers], numbers)
        far = np.sqrt(squared.astype(np.float64))
        vantage = int(np.argmax(far.var(axis=1)))  # the widest view parts best
        order = np.lexsort((numbers, squared[vantage]))
        order = order[order != vantage]
        self.points[at] = numbers[[vantage]]
        half = len(order) // 2
        for part in (order[:half], order[half:]):
            seen = far[vantage][part]
            self.children[at].append((self._add(numbers[part], leaf), float(seen.min()), float(seen.max())))
        return at

    def distances(self, v: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Exact squared distances of v to the numbered centroids."""
        return (v**2).sum(axis=1)[:, None] - 2 * (v @ self.centroids[numbers].T) + self.squares[numbers][None, :]

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of each vector's nearest centroid, ties to the smaller number, and the number of distances taken."""
        n = len(v)
        best, number = np.full(n, FAR), np.full(n, FAR)
        bounds = np.full((n, len(self.points)), np.inf)
        bounds[:, :1] = 0
        active, taken = np.arange(n), 0
        while len(active):
            node = np.argmin(bounds[active], axis=1)
            bound = bounds[active, node]
            # roots are rounded, so the radius is a little wide
            go = bound <= np.sqrt(best[active].astype(np.float64)) * (1 + 1e-9)
            active, node, bound = active[go & np.isfinite(bound)], node[go & np.isfinite(bound)], bound[go & np.isfinite(bound)]
            bounds[active, node] = np.inf
            for at in np.unique(node):
                rows, least = active[node == at], bound[node == at]
                numbers = self.points[at]
                found = self.distances(v[rows], numbers)
                taken += found.size
                first = np.argmin(found, axis=1)  # the points of a leaf are in order
                near, name = found[np.arange(len(rows)), first], numbers[first]
                better = (near < best[rows]) | ((near == best[rows]) & (name < number[rows]))
                best[rows[better]], number[rows[better]] = near[better], name[better]
                away = np.sqrt(found[:, 0].astype(np.float64))
                for child, low, high in self.children[at]:
                    # roots are rounded, the more the longer they are
                    bounds[rows, child] = np.maximum(least, np.maximum(low - away, away - high) * (1 - 1e-9) - 1e-12 * (away + high))
        return number, best, taken


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)
    if v.size and 4 * dim * int(max(v.max(), -int(v.min()))) ** 2 >= 2**62:
        raise OverflowError("squared distances could exceed a long")
    return v


def _runs(batches, dim: int):
    for batch in batches:
        for start in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(start, TOGETHER)
            yield part, _vectors(part, dim)


def kept_vectors(rows: DataFrame, dim: int = DIM) -> DataFrame:
    """(vec_id, v) of the rows (vec_id, embedding) that take part, v in integers."""
    vector = F.col("embedding")
    return rows.filter(valid(vector) & (F.size(vector) == dim)).select("vec_id", quantised(vector).alias("v"))


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, seed: str = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid array<long>, centroid_sha256) of every row of vectors (vec_id, v array<long> of dim components)."""
    data = stash(vectors.select("vec_id", "v"), "vectors")
    spark = data.sparkSession
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centroids = np.array([r.v for r in data.orderBy(digest.asc_nulls_last(), "v").limit(k).collect()], np.int64).reshape(-1, dim)

    def sums(tree):
        def work(batches):
            total, count = np.zeros((len(tree.value.centroids), dim), np.int64), np.zeros(len(tree.value.centroids), np.int64)
            for _, v in _runs(batches, dim):
                number = tree.value.nearest(v)[0]
                order = np.argsort(number, kind="stable")
                found, first = np.unique(number[order], return_index=True)
                total[found] += np.add.reduceat(v[order], first, axis=0)
                count += np.bincount(number, minlength=len(count))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(count[some]), "sums": pa.array(list(total[some]), pa.list_(pa.int64()))})

        return work

    for _ in range(rounds if len(centroids) else 0):
        tree = spark.sparkContext.broadcast(Tree(centroids))
        parts = data.select("v").mapInArrow(sums(tree), "cluster int, n long, sums array<long>")
        whole = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(dim)]
        for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *whole).collect():  # k rows
            centroids[row.cluster] = [int(row[f"s{i}"]) // row.n for i in range(dim)]
        tree.unpersist()
    tree = spark.sparkContext.broadcast(Tree(centroids))

    def assign(batches):
        for part, v in _runs(batches, dim):
            number, distance, _ = tree.value.nearest(v)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    done = stash(data.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r.cluster: r.total for r in done.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # k rows
    known = [(i, inertia[i], sum(inertia.values()), c.tolist(), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids) if i in inertia]
    known = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    # k rows
    return done.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
