import hashlib
import math

import numpy as np
import pytest

from cohortweave.llm import centroids as C

SCHEMA = "vec_id long, embedding array<double>, cluster int, key string, vector int"


def brute(rows, k, size, scale=64, rounds=3):
    """(vec_id, cluster, distance, cluster_inertia, inertia, sha256) in Python integers."""
    kept = [
        (i, [math.floor(scale * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [list(v) for _, v in named[:k]]
    if not centres:
        return []
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for turn in range(rounds + 1):
        own = [min(range(len(centres)), key=lambda c: (far(v, centres[c]), c)) for _, v in kept]
        if turn < rounds:
            for c in range(len(centres)):
                mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
                if mine:
                    centres[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    made = [(i, o, far(v, centres[o])) for (i, v), o in zip(kept, own, strict=True)]
    total = sum(d for _, _, d in made)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(i, o, d, sum(e for _, p, e in made if p == o), total, names[o]) for i, o, d in made]


def values(df):
    return sorted(
        ((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect()), key=str
    )


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "k", 2) for i, v in rows], SCHEMA)


def test_distances_are_looked_up():
    rng = np.random.default_rng(1)
    for spread in (3, 1 << 20):
        vectors, centres = rng.integers(-spread, spread, (200, 5)), rng.integers(-spread, spread, (7, 5))
        assert (C.distances(vectors, centres) == ((vectors[:, None] - centres[None]) ** 2).sum(axis=2)).all()
    values_, place = C.occurring(np.array([5, -3, 5, 9]))
    assert values_.tolist() == [-3, 5, 9] and values_[place].tolist() == [5, -3, 5, 9]


def test_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.standard_normal(4) / 4]) for k in range(300)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]  # repeated keys, no key
    rows += [(400 + k, [0.25, -0.25, 0.5, 0.0]) for k in range(100)]  # a group of copies
    nan, inf = float("nan"), float("inf")
    rows += [(900, None), (901, []), (902, [1.0, 2.0]), (903, [nan] * 4), (904, [inf, 0.0, 0.0, 0.0]), (905, [None, 0.0, 0.0, 0.0])]
    rows += [(906, [-inf, 0.0, 0.0, 0.0]), (907, [1e5, -1e5, 3.0, 0.0])]
    for parts in (1, 5):
        found = values(C.cluster(frame(spark, rows).repartition(parts), "vec_id", "embedding", k=6, size=4))
        assert found == sorted(brute(rows, 6, 4), key=str)


def test_ties_and_empty_centroids(spark):
    rows = [(k, [1.0, 0.0]) for k in range(5)] + [(k, [0.0, 0.0]) for k in range(5, 9)]  # equal centroids: smaller numbers
    found = values(C.cluster(frame(spark, rows), "vec_id", "embedding", k=4, size=2))
    assert found == sorted(brute(rows, 4, 2), key=str)
    few = [(3, [0.1, 0.2]), (4, [-0.1, 0.2])]
    assert values(C.cluster(frame(spark, few), "vec_id", "embedding", size=2)) == sorted(brute(few, 16, 2), key=str)


def test_nothing_to_cluster(spark):
    for rows in ([], [(1, None)], [(None, [1.0, 2.0])]):
        found = C.cluster(frame(spark, rows), "vec_id", "embedding", size=2)
        assert found.collect() == [] and found.columns[:3] == ["vec_id", "cluster", "distance"]


def test_too_large_for_exact_distances(spark):
    with pytest.raises(Exception, match="too large for exact distances"):
        C.cluster(frame(spark, [(1, [1e30, 0.0])]), "vec_id", "embedding", size=2)
