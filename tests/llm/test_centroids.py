"""Centroid clustering against full distances, and the search's abandoning against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from lexforge.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    sha = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "")
    cents = [v for _, v in sorted(kept, key=lambda r: (sha(r[0]), r[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        got = [(near(v)[1], v) for _, v in kept]
        for j in range(len(cents)):
            own = [v for w, v in got if w == j]
            if own:
                cents[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    by = {j: sum(d for _, w, d in out if w == j) for j in range(len(cents))}
    return sorted(((i, w, d, by[w], sum(by.values()), hashlib.sha256(",".join(map(str, cents[w])).encode()).hexdigest()) for i, w, d in out), key=str)


def rows_of(seed, n, dims, values):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, i, None, 3]), [np.float32(rng.choice(values)).item() for _ in range(dims)]) for i in range(n)]
    rows += rows[:5] * 6
    return [*rows, (900, None), (901, [1.0] * (dims - 1)), (902, [None] + [1.0] * (dims - 1)), (903, [float("nan")] * dims), (904, [float("-inf")] * dims), (905, [])]


@pytest.mark.parametrize(("seed", "dims", "k", "values"), [(1, 64, 40, [-1.5, -0.001, 0.0, 0.3, 2.7]), (2, 5, 7, [0.0, 1.0]), (3, 64, 3, [0.1, -0.1, 100.0, 1000.0]), (4, 9, 500, [0.5, -0.25, 7.0])])
def test_clusters(spark, seed, dims, k, values):
    rows = rows_of(seed, 120, dims, values)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in centroids.cluster_vectors(df, k, 3, dims).collect()), key=str)
    assert got == brute(rows, k, 3, dims)


def test_search_finds_the_nearest_and_the_smaller_number():
    rng = np.random.default_rng(1)
    for dims in (1, 8, 9, 33, 64):
        x = rng.integers(-3, 4, (400, dims))
        c = rng.integers(-3, 4, (30, dims))
        c[20:] = c[:10]  # ties
        full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        who, d = centroids.nearest(x, c, rng.permutation(dims))
        assert (d == full.min(axis=1)).all() and (who == full.argmin(axis=1)).all()


def test_empty_large_and_clashing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert centroids.cluster_vectors(empty).count() == 0
    big = spark.createDataFrame([(1, [1e30] * 64, 1)], SCHEMA)
    with pytest.raises(Exception, match="overflow"):
        centroids.cluster_vectors(big).count()
    most = float((1 << 27) // 256)
    edge = spark.createDataFrame([(1, [most] * 64, "a", 1), (2, [-most] * 64, "b", 2)], "vec_id long, embedding array<double>, cluster string, id int")
    got = centroids.cluster_vectors(edge, 1, 0).collect()
    assert sorted(r["distance"] for r in got) == [0, 64 << 56]
    assert {r["inertia"] for r in got} == {64 << 56}
