"""Orchard's search and the clustering against full distance tables."""

import hashlib
import math

import numpy as np
import pytest

from skylattice.llm import orchard


def full(vectors, centroids):
    d = ((vectors[:, None, :].astype(np.int64) - centroids[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize("seed", range(12))
def test_search_finds_the_nearest_with_ties(seed):
    rng = np.random.default_rng(seed)
    k, dims = int(rng.integers(1, 50)), int(rng.integers(1, 7))
    centroids = rng.integers(-4, 5, (k, dims))  # repeated centroids and equal distances
    vectors = rng.integers(-6, 7, (400, dims)).astype(np.int32)
    got, want = orchard.nearest(vectors, centroids), full(vectors, centroids)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_largest_components_do_not_overflow():
    centroids = np.array([[orchard.MOST] * 64, [-orchard.MOST] * 64], np.int64)
    vectors = np.array([[-orchard.MOST] * 64, [orchard.MOST] * 64], np.int32)
    assert orchard.nearest(vectors, centroids)[0].tolist() == [1, 0]


def brute(rows, k=40, rounds=5):
    """The contract's rule, step by step."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centroids = [v for _, v in first]
    data = np.array([v for _, v in kept], np.int64)
    for _ in range(rounds):
        cluster, _ = full(data, np.array(centroids))
        for c in range(len(centroids)):
            own = data[cluster == c]
            if len(own):
                centroids[c] = [int(s) // len(own) for s in own.sum(axis=0)]
    cluster, distance = full(data, np.array(centroids))
    sums = np.bincount(cluster, distance, len(centroids)).astype(int)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, int(c), int(d), int(sums[c]), int(distance.sum()), digest[c]) for (i, _), c, d in zip(kept, cluster, distance))


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=64)], i) for i in range(150)]
    rows += [(200 + i, rows[0][1], 0) for i in range(70)]  # copies
    rows += [(300, None, 0), (301, [], 0), (302, [1.0] * 63, 0), (303, [1.0] * 63 + [None], 0), (304, [1.0] * 63 + [float("nan")], 0), (305, [1.0] * 63 + [float("inf")], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int")
    assert sorted(map(tuple, orchard.clusters(table.repartition(5)).collect())) == brute([r[:2] for r in rows])


def test_few_vectors_null_ids_and_no_vectors(spark):
    table = spark.createDataFrame([(None, [0.0] * 64), (1, [1.0] * 64), (1, [1.0] * 64)], "vec_id long, embedding array<double>")
    got = orchard.clusters(table).collect()
    assert len(got) == 3 and sum(r["distance"] for r in got) == 0
    assert orchard.clusters(table.limit(0)).collect() == []
    assert orchard.clusters(table.select("vec_id", "embedding"), k=1).select("inertia").first()[0] > 0
