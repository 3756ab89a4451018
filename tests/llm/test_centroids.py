import hashlib
import math
import random

import numpy as np
import pytest

from fieldlake.llm.centroids import VantageTree, cluster
from fieldlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, size, rounds, dimensions=64, scale=256, seed=2):
    """Everything in Python integers, every vector against every centroid."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    by_hash = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in by_hash[:size]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, vs in groups.items():
            centroids[n] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    placed = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {}
    for _, n, d in placed:
        inertia[n] = inertia.get(n, 0) + d
    return sorted(((-1 if i is None else i), n, d, inertia[n], sum(inertia.values()), tuple(centroids[n])) for i, n, d in placed)


def found(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in df.collect())


@pytest.mark.parametrize("spread", [2, 1000])
@pytest.mark.parametrize("leaf", [1, 3, 8])
def test_tree_finds_the_smallest_number_of_the_nearest(spread, leaf):
    rng = np.random.default_rng(leaf)
    for size in (1, 2, 7, 60):
        centroids = rng.integers(-spread, spread + 1, (size, 3))
        rows = rng.integers(-2 * spread, 2 * spread + 1, (700, 3))
        every = ((rows[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        number, best = VantageTree(centroids, leaf).nearest(rows)
        assert number.tolist() == every.argmin(axis=1).tolist() and best.tolist() == every.min(axis=1).tolist()


def test_tree_prunes_and_stays_exact_for_large_components():
    rng = np.random.default_rng(8)
    centroids = rng.integers(-(2**27), 2**27, (64, 2))
    rows = centroids[rng.integers(0, 64, 500)] + rng.integers(-3, 4, (500, 2))
    tree = VantageTree(centroids)
    every = ((rows[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    seen = []
    tree._offer = lambda number, best, at, centroid, distance: (seen.append(len(at)), VantageTree._offer(number, best, at, centroid, distance))
    number, _ = tree.nearest(rows)
    assert number.tolist() == every.argmin(axis=1).tolist()
    assert sum(seen) < 500 * 64 / 2


def test_copies_bad_rows_ties_and_clashing_names(spark):
    rng = random.Random(4)
    good = [(i, [rng.randint(-3, 3) / 4 for _ in range(4)]) for i in range(150)]
    good += [(200 + i, [0.5, -0.5, 0.25, 1e-9]) for i in range(90)] + [good[3], good[3], (None, [1.0, 2.0, 3.0, 4.0]), (5, [9.0] * 4)]
    bad = [(300, None), (301, []), (302, [1.0] * 3), (303, [1.0, None, 1.0, 1.0]), (304, [float("nan")] * 4), (305, [1.0, float("-inf"), 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in good + bad], "vec_id long, embedding array<double>, cluster int, centroid double")
    assert found(cluster(df, size=9, rounds=3, dimensions=4)) == brute(good + bad, 9, 3, 4)


def test_fewer_vectors_than_centroids(spark):
    rows = [(i, [float(i), 0.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found(cluster(df, size=5, rounds=2, dimensions=2)) == brute(rows, 5, 2, 2)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1e300] * 64)]])
def test_nothing_usable(spark, rows):
    assert cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect() == []


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = [(i, n, d, c, t, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for i, n, d, c, t, v in brute(rows, 40, 5)]
    got = sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in QUERIES["op13_centroids"](spark, SF).collect())
    assert got == want
