"""Clustering against plain integer k-means and a bound that never hides the nearest centroid."""

import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from specweave.llm import clusters


def plain(rows, k, rounds, seed):
    """rows: (id, components). Every distance, by Python integers."""
    own = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows]
    first = sorted(own, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in own:
            members[near(v)[1]].append(v)
        centroids = [[sum(col) // len(m) for col in zip(*m, strict=True)] if m else c for m, c in zip(members, centroids, strict=True)]
    found = [(i, *near(v)) for i, v in own]
    inertia = [sum(f[1] for f in found if f[2] == n) for n in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, n, d, inertia[n], sum(inertia), sha[n]) for i, d, n in found)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect())


def test_against_plain(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=64) * (1 if i % 3 else 40)).round(3).tolist()) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(30)]  # copies, so ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert rows_of(clusters.cluster(df, k=12, rounds=3)) == plain(rows, 12, 3, 2)


def test_edges(spark):
    good = [0.5] * 64
    rows = [(1, good), (2, None), (3, good[:-1]), (4, [*good, 1.0]), (5, [*good[:-1], None]), (6, [*good[:-1], float("nan")]), (7, [*good[:-1], float("inf")]), (8, [*good[:-1], 1e9]), (1, good), (None, [-0.25] * 64)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<float>, `cluster` string, `Distance` int")
    got = clusters.cluster(df, k=40)
    assert sorted(((r["vec_id"], r["distance"]) for r in got.collect()), key=str) == [(1, 0), (1, 0), (None, 0)]
    assert clusters.cluster(df, k=2, rounds=0).filter("vec_id is null").first()["distance"] == 64 * (128 + 64) ** 2
    assert clusters.cluster(df.filter("vec_id > 99")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 50, 10**4, clusters.MOST]), st.integers(1, 9))
def test_bound_keeps_the_nearest(seed, size, k):
    rng = np.random.default_rng(seed)
    c = rng.integers(-size, size, (k, 64))
    v = np.concatenate([c[rng.integers(0, k, 20)] + rng.integers(-1, 2, (20, 64)), rng.integers(-size, size, (20, 64))])
    got, distance, exact = clusters.nearest(v, clusters.segment_norms(v), c)
    full = np.square(v[:, None] - c[None]).sum(axis=2)
    assert (got == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all() and (exact <= k).all()


def test_screening_saves_distances():
    rng = np.random.default_rng(0)
    c = rng.normal(size=(40, 64)) * rng.uniform(1, 100, size=(40, 1))
    c = np.floor(c * 256).astype(np.int64)
    v = c[rng.integers(0, 40, 500)] + rng.integers(-9, 9, (500, 64))
    assert clusters.nearest(v, clusters.segment_norms(v), c)[2].mean() < 10
