"""Exact integer k-means with Ptolemaic pivots.

For points x, c and pivots p, s of a Euclidean space, Ptolemy's inequality gives
|d(x,p) d(c,s) - d(x,s) d(c,p)| / d(p,s) <= d(x,c). Pivot distances of the vectors are worked out once and stored beside
them; those of the few centroids are new in each round. The pivots are the first centroids, so a distance between a vector
and a centroid that has not moved is met exactly. The centroid of the least bound is checked first, exactly; all
whose bound, rounded down, may still reach that distance are checked exactly as well, and the others are left out.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
SLACK = 1e-9  #: share of a bound given up for rounding, a million times what doubles lose here
LONGEST = 2.0**60  #: squared length up to which every squared distance fits a long


def integers(vectors: DataFrame, vec: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): vectors of ``dimensions`` finite components as whole numbers floor(scale * component).

    Others (null, shorter, longer, with a null, NaN or infinite component) are left out, and so are vectors of a squared length
    over 2 ** 60, whose distances no long holds.
    """
    real = F.transform(vec, lambda y: y.cast("double"))
    finite = (F.size(vec) == dimensions) & ~F.exists(real, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")))
    scaled = F.transform(real, lambda y: F.floor(y * scale))
    length = F.aggregate(real, F.lit(0.0), lambda s, y: s + (y * scale) * (y * scale))
    return vectors.where(F.coalesce(finite & (length <= LONGEST), F.lit(False))).select("vec_id", scaled.alias("x"))


def by_hash(rows: DataFrame, n: int, seed: int = SEED) -> np.ndarray:
    """The ``n`` vectors of the smallest hash of their id; of equal hashes the smaller vector first, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r.x for r in rows.orderBy(key.asc_nulls_last(), "x").limit(n).select("x").collect()], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([squared(x, p) for p in pivots], axis=1).astype(np.float64))


def lower_bounds(dx: np.ndarray, dc: np.ndarray, dp: np.ndarray) -> np.ndarray:
    """For every row and centroid a number not above their distance: the best of all pivot pairs, rounded down."""
    out = np.zeros((len(dx), len(dc)))
    for p, s in combinations(range(dp.shape[0]), 2):
        a, b = dx[:, p, None] * dc[None, :, s], dx[:, s, None] * dc[None, :, p]
        np.maximum(out, (np.abs(a - b) - SLACK * (a + b)) / dp[p, s], out=out)
    return out * (1 - SLACK)


def nearest(x: np.ndarray, dx: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every row the nearest centroid (ties: the smaller number) and the squared distance; how many were worked out."""
    bounds = lower_bounds(dx, pivot_distances(centroids, pivots), pivot_distances(pivots, pivots))
    number = bounds.argmin(axis=1)
    best = squared(x, centroids[number])
    tried = len(x)
    first = number.copy()
    for k in range(len(centroids)):
        # a bound is a distance; squares over 2 ** 53 lose digits in a double, hence the slack
        reach = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
        at = np.flatnonzero((first != k) & (bounds[:, k] <= reach))
        d = squared(x[at], centroids[k])
        better = (d < best[at]) | ((d == best[at]) & (k < number[at]))
        best[at[better]], number[at[better]] = d[better], k
        tried += len(at)
    return number, best, tried


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def with_distances(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The rows with ``d``, their distances from the pivots: written once and read in every round."""

    def run(batches):
        for batch in batches:
            d = pivot_distances(_matrix(batch.column(1)), pivots) if batch.num_rows else np.empty((0, len(pivots)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * len(pivots)), pa.array(d.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["vec_id", "x", "d"])

    return rows.mapInArrow(run, "vec_id long, x array<long>, d array<double>")


def sums(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """By cluster the number of vectors and the sums of their components, of one assignment.

    A task sends a row for each cluster and component, and as many reach the driver.
    """
    names = ["cluster", "place", "n", "high", "low"]

    def run(batches):
        n = np.zeros(len(centroids), np.int64)
        high, low = np.zeros(centroids.shape, np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            number, _, _ = nearest(x, _matrix(batch.column(1)), centroids, pivots)
            for k in np.unique(number):
                mine = x[number == k]
                n[k] += len(mine)
                high[k] += (mine >> 31).sum(axis=0)  # two parts, so that no sum overflows
                low[k] += (mine & (2**31 - 1)).sum(axis=0)
        cluster, place = (i.ravel() for i in np.indices(centroids.shape, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (cluster, place, n[cluster], high.ravel(), low.ravel())], names)

    parts = stored.select("x", "d").mapInArrow(run, "cluster long, place long, n long, high long, low long")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), total("high"), total("low")).where("n > 0").collect()
    out: dict[int, tuple[int, list[int]]] = {r.cluster: (r.n, [0] * centroids.shape[1]) for r in rows}
    for r in rows:
        out[r.cluster][1][r.place] = (int(r.high) << 31) + int(r.low)
    return out


def assigned(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance, tried): one row for each vector; ``tried`` centroids of its batch a vector were checked exactly."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            number, best, tried = nearest(_matrix(batch.column(1)), _matrix(batch.column(2)), centroids, pivots)
            share = np.full(len(best), tried / len(best))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(best), pa.array(share)], ["vec_id", "cluster", "distance", "tried"])

    return stored.mapInArrow(run, "vec_id long, cluster int, distance long, tried double")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def k_means(vectors: DataFrame, vec: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> tuple[DataFrame, np.ndarray]:
    """The assignment (vec_id, cluster, distance, tried) after ``rounds`` rounds, and the centroids.

    Centroids begin as the kept vectors of the smallest id hashes; each round replaces those with vectors by the floor of the
    mean. Repeated rows count as often as they occur; fewer kept vectors than clusters give fewer centroids; null ids are
    kept; an empty table gives an empty result. Further columns are ignored.
    """
    rows = integers(vectors, vec, dimensions)
    centroids = by_hash(rows, clusters, seed)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0.0).alias("tried")), centroids
    pivots = np.unique(centroids, axis=0)
    stored = keep(with_distances(rows, pivots))
    for _ in range(rounds):
        for k, (n, total) in sums(stored, centroids, pivots).items():
            centroids[k] = [t // n for t in total]
    return assigned(stored, centroids, pivots), centroids


def per_vector(vectors: DataFrame) -> DataFrame:
    """One row for each kept vector with its cluster, squared distance, inertia of the cluster and of all, and the centroid's digest."""
    found, centroids = k_means(vectors)
    found = keep(found.select("vec_id", "cluster", "distance"))
    spark = found.sparkSession
    totals = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("s")).collect()}  # a row for each cluster
    rows = [(k, totals[k], sum(totals.values()), digest(centroids[k])) for k in totals]
    by_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
