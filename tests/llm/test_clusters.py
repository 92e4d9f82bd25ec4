"""Exact k-means against plain Python, and bounds that are never above a distance."""

import hashlib
import random

import numpy as np

from trendloom.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, cluster int"


def plain(rows, dimensions, k, rounds):
    kept = [(i, [int(np.floor(1024 * y)) for y in v]) for i, v in rows if v and len(v) == dimensions and all(y is not None and np.isfinite(y) for y in v)]
    centroids = [x for _, x in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign():
        out = []
        for i, x in kept:
            d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in centroids]
            out.append((i, d.index(min(d)), min(d), x))
        return out

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            if mine := [x for _, c, _, x in found if c == j]:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return sorted((i, c, d) for i, c, d, _ in assign()), centroids


def test_equal_to_plain_rounds(spark):
    draw = random.Random(3)
    rows = [(i, [draw.choice([-1.5, 0.0, 0.25, 3.0]) + draw.random() / 8 for _ in range(4)]) for i in range(200)]
    rows += [(7, rows[7][1]), (900, None), (901, [1.0]), (902, [1.0, None, 1.0, 1.0]), (903, [float("nan")] * 4), (904, [float("inf")] * 4), (905, [0.0] * 4), (906, [0.0] * 4)]
    df = spark.createDataFrame([(*r, 5) for r in rows], SCHEMA).repartition(3)
    found, centroids = clusters.k_means(df, clusters=5, rounds=4, dimensions=4)
    want, plain_centroids = plain(rows, 4, 5, 4)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in found.collect()) == want
    assert centroids.tolist() == plain_centroids


def test_ties_go_to_the_smaller_number():
    x = np.array([[0, 0], [10, 0]], np.int64)
    centroids = np.array([[5, 5], [5, -5], [5, 5]], np.int64)
    number, best, _ = clusters.nearest(x, clusters.pivot_distances(x, centroids[:2]), centroids, centroids[:2])
    assert number.tolist() == [0, 0] and best.tolist() == [50, 50]


def test_bounds_hold_and_leave_out_centroids():
    draw = np.random.default_rng(1)
    middles = draw.integers(-100_000, 100_000, (8, 16))
    x = np.repeat(middles, 50, axis=0) + draw.integers(-50, 50, (400, 16))
    pivots = middles[:6]
    bounds = clusters.lower_bounds(clusters.pivot_distances(x, pivots), clusters.pivot_distances(middles, pivots), clusters.pivot_distances(pivots, pivots))
    exact = np.sqrt(((x[:, None] - middles[None]) ** 2).sum(axis=2).astype(float))
    assert (bounds <= exact).all()
    number, best, tried = clusters.nearest(x, clusters.pivot_distances(x, pivots), middles, pivots)
    assert number.tolist() == np.repeat(np.arange(8), 50).tolist() and tried < 3 * len(x)


def test_edge_tables(spark):
    assert clusters.per_vector(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    few = spark.createDataFrame([(1, [0.5] * 64), (None, [0.5] * 64), (3, [1e30] * 64)], "vec_id long, embedding array<float>")
    got = clusters.per_vector(few).collect()  # two equal vectors; the third is beyond what a distance can say
    assert sorted((r.vec_id or 0, r.cluster, r.distance, r.inertia) for r in got) == [(0, 0, 0, 0), (1, 0, 0, 0)]
    assert {r.centroid_sha256 for r in got} == {hashlib.sha256(",".join(["512"] * 64).encode()).hexdigest()}
