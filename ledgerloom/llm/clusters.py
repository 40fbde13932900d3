"""Clusters of vectors around integer centroids, by rounds of assignment with the Shallot search.

Components become integers; centroids are integers too, each the floor of its vectors' mean.  Between rounds a
vector remembers its nearest centroid, the second-nearest one, an upper bound of its distance to the nearest and
a lower bound of its distance to every other (Borgelt 2020, after Hamerly 2010, and Newling and Fleuret 2016).
When centroids have moved, the bounds give way by as much.  A vector stays where it is if its upper bound is
below its lower bound, or below half the way from its centroid to the next one.  Else both remembered centroids
are measured and the search begins at the closer one: the others are visited in order of their distance from it, as
long as they lie in the ball around it whose radius is the distance to it plus that to the second-nearest centroid so
far.  The ball shrinks as nearer ones are found.  Whatever is visited is compared in integers; bounds and balls
are rounded outward and hold at equality, so ties go to the smaller number.

A round is one pass over a table of the vectors' state, without a shuffle; a task gives sums for each centroid
beside its rows.  The table of a round is written to the shared folder, and goes when the next one is complete.
A round that moves no centroid is the last one needed: those after it would change nothing.

Defined results: rows whose vector is null, holds null or non-finite components or has not ``length`` components
take no part; rows that share a ``vec_id`` are each assigned, and each may be a first centroid, in order of their
vectors; rows without an id come last in that order; with fewer rows than ``centroids`` there are as many
centroids as rows; components beyond 2 ** 24 / ``scale`` count as that; an empty table gives no row; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import drop, fresh_folder
from .lattice import BLOCK, Sums, above, below, lists, matrix, means, squared, whole_rows
from .ship import session_of

CENTROIDS = 8
ROUNDS = 10
SCALE = 1024
LENGTH = 64
SEED = 3

_NAMES = ["vec_id", "vector", "cluster", "second", "upper", "lower", "distance", "entry", "many", "total", "inertia"]
_STATE = "vec_id long, vector array<int>, cluster int, second int, upper double, lower double, distance long, entry int, many long, total array<long>, inertia long"


class Centroids:
    """Integer centroids, their order by distance from each other, and how far each has moved."""

    def __init__(self, places: np.ndarray, drift: np.ndarray | None = None):
        self.places, self.drift = places, drift
        apart = squared(places, places)
        np.fill_diagonal(apart, -1)  # itself first, before equal ones
        self.order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.apart = below(np.take_along_axis(apart, self.order, axis=1))
        self.half = self.apart[:, 0] / 2 if len(places) > 1 else np.full(1, np.inf)

    def moved(self, places: np.ndarray) -> Centroids:
        gap = places - self.places
        return Centroids(places, above((gap * gap).sum(axis=1)))

    def measured(self, points: np.ndarray, centroid: np.ndarray) -> np.ndarray:
        gap = points - self.places[centroid]
        return np.einsum("ij,ij->i", gap, gap)

    def first(self, points: np.ndarray) -> tuple[np.ndarray, ...]:
        """(cluster, second, upper, lower) of points compared with every centroid."""
        apart = squared(points, self.places)
        order = np.argsort(apart, axis=1, kind="stable")[:, :2]
        near = np.take_along_axis(apart, order, axis=1)
        if len(self.places) == 1:
            return order[:, 0], np.full(len(points), -1), above(near[:, 0]), np.full(len(points), np.inf)
        return order[:, 0], order[:, 1], above(near[:, 0]), below(near[:, 1])

    def search(self, points: np.ndarray, cluster: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same after centroids have moved, from what was remembered; how many were measured comes last."""
        cluster, second = cluster.copy(), second.copy()
        if len(self.places) == 1:
            return cluster, second, above(self.measured(points, cluster)), lower, len(points)
        upper = np.nextafter(upper + self.drift[cluster], np.inf)
        # The farthest any other centroid has moved.
        top = np.argsort(self.drift)[::-1]
        lower = np.nextafter(lower - np.where(cluster == top[0], self.drift[top[1]], self.drift[top[0]]), -np.inf)
        open_ = np.flatnonzero(upper >= np.maximum(lower, self.half[cluster]))
        near = self.measured(points[open_], cluster[open_])
        upper[open_] = above(near)
        measured = len(open_)
        unsettled = upper[open_] >= np.maximum(lower[open_], self.half[cluster[open_]])
        open_, near = open_[unsettled], near[unsettled]
        x, a, b = points[open_], cluster[open_], second[open_]
        far = self.measured(x, b)
        measured += len(open_)
        # Begin at the closer one.
        swap = (far < near) | ((far == near) & (b < a))
        a, b, near, far = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, far, near), np.where(swap, near, far)
        start, met, way = a.copy(), b.copy(), above(near)
        going = np.arange(len(open_))
        for k in range(len(self.places) - 1):
            radius = np.nextafter(way[going] + above(far[going]), np.inf)
            going = going[self.apart[start[going], k] <= radius]
            if not len(going):
                break
            c = self.order[start[going], k]
            new = c != met[going]
            at, c = going[new], c[new]
            d = self.measured(x[at], c)
            measured += len(at)
            wins = (d < near[at]) | ((d == near[at]) & (c < a[at]))
            next_ = ~wins & ((d < far[at]) | ((d == far[at]) & (c < b[at])))
            won, then = at[wins], at[next_]
            b[won], far[won], a[won], near[won] = a[won], near[won], c[wins], d[wins]
            b[then], far[then] = c[next_], d[next_]
        cluster[open_], second[open_], upper[open_], lower[open_] = a, b, above(near), below(far)
        return cluster, second, upper, lower, measured


def _pass(state: DataFrame, centroids: Centroids, last: bool = False) -> DataFrame:
    """Rows of ``state`` assigned anew, and sums for each centroid of each task; distances in the ``last`` pass."""
    size, first = len(centroids.places), centroids.drift is None

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = centroids.places.shape[1]
        sums, spread = Sums(size, width), np.zeros(size, np.int64)
        step = max(1, BLOCK // width)
        for whole in batches:
            for begin in range(0, len(whole), step):
                batch = whole.slice(begin, step)
                n, points = len(batch), matrix(batch.column(1))
                if first:
                    cluster, second, upper, lower = centroids.first(points)
                else:
                    held = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6)]
                    cluster, second, upper, lower, _ = centroids.search(points, held[0].astype(np.int64), held[1].astype(np.int64), *held[2:])
                none = distance = pa.nulls(n, pa.int64())
                sums.add(points, cluster)
                if last:
                    distance = centroids.measured(points, cluster)
                    np.add.at(spread, cluster, distance)
                columns = [batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(second, pa.int32()), pa.array(upper), pa.array(lower), pa.array(distance, pa.int64()), none.cast(pa.int32()), none, pa.nulls(n, pa.list_(pa.int64())), none]
                yield pa.RecordBatch.from_arrays(columns, names=_NAMES)
        used = np.flatnonzero(sums.count)
        empty = [pa.nulls(len(used), kind) for kind in (pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(used, pa.int32()), pa.array(sums.count[used]), lists(sums.total[used], pa.int64()), pa.array(spread[used])], names=_NAMES)

    return state.mapInArrow(apply, _STATE)


def clustered(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, length: int = LENGTH, seed: int = SEED) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every row that takes part, (cluster, cluster_inertia, inertia), and the centroids."""
    spark = session_of(vectors)
    rows = whole_rows(vectors.where(F.size("embedding") == length), scale)
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "vector"]
    begin = [r.vector for r in rows.orderBy(*order).limit(centroids).collect()]
    if not begin:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), spark.createDataFrame([], "cluster int, cluster_inertia long, inertia long"), np.zeros((0, length), np.int64)
    now = Centroids(np.array(begin, np.int64))
    folder, before = fresh_folder(spark, "clusters"), None
    for k in range(rounds):
        _pass(rows, now).write.parquet(f"{folder}/round-{k}")
        if before:
            drop(spark, before)
        before = f"{folder}/round-{k}"
        state = spark.read.schema(_STATE).parquet(before)
        rows = state.where("entry IS NULL").select(*_NAMES[:6])
        places = means(state, now.places)
        still, now = np.array_equal(places, now.places), now.moved(places)
        if still:
            break
    _pass(rows, now, last=True).write.parquet(f"{folder}/clusters")
    if before:
        drop(spark, before)
    state = spark.read.schema(_STATE).parquet(f"{folder}/clusters")
    sums = state.where("entry IS NOT NULL").groupBy("entry").agg(F.sum("inertia").alias("inertia")).collect()  # one row a centroid
    total = sum(r.inertia for r in sums)
    inertia = spark.createDataFrame([(r.entry, r.inertia, total) for r in sums], "cluster int, cluster_inertia long, inertia long")
    return state.where("entry IS NULL").select("vec_id", "cluster", "distance"), inertia, now.places


def vector_clusters(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every row that takes part."""
    assigned, inertia, places = clustered(vectors, centroids, rounds, scale, length, seed)
    seals = [(k, hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for k, p in enumerate(places.tolist())]
    sealed = assigned.sparkSession.createDataFrame(seals, "cluster int, centroid_sha256 string")
    # One row a centroid: as many as the parameter says.
    return assigned.join(F.broadcast(inertia.join(sealed, "cluster")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
