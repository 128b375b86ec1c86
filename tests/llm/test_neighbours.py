import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortweave.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, score int"


def asks():
    return F.col("vec_id") % 5 == 0



def brute(rows, k):
    """By id: [(vec_id, score)] of the nearest."""
    out = {}
    for i, v in rows:
        if i % 5 == 0:
            scored = sorted((-sum(float(a) * float(b) for a, b in zip(v, w, strict=True)), j) for j, w in rows if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def search(spark, rows, k, **more):
    found = N.search(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA), "vec_id", "embedding", asks(), k, **more)
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_exact_where_all_lists_are_visited(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(np.float32(x)) for x in rng.standard_normal(24) * (1 + k % 3)]) for k in range(200)]
    rows += [(500 + k, rows[7][1]) for k in range(40)]  # ties
    found, truth = search(spark, rows, 10), brute(rows, 10)
    assert found.keys() == truth.keys()
    share = [len({j for j, _ in found[i]} & {j for j, _ in truth[i]}) / 10 for i in truth]
    assert np.mean(share) > 0.98
    for i in truth:
        vector = dict(rows)
        exact = [sum(a * b for a, b in zip(vector[i], vector[j], strict=True)) for j, _ in found[i]]
        assert np.allclose([s for _, s in found[i]], exact, rtol=0, atol=1e-12)
        scores = [(-s, j) for j, s in found[i]]
        assert scores == sorted(scores)


def test_recall_on_a_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = N.search(table, "vec_id", "embedding", F.col("vec_id") % 20 == 0).collect()
    rows = table.collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    got = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    share = []
    for i in np.flatnonzero(ids % 20 == 0):
        score = vectors @ vectors[i]
        score[i] = -np.inf
        share.append(len(got[ids[i]] & set(ids[np.argsort(-score)[:20]])) / 20)
    assert len(share) == len(got) and np.mean(share) > 0.9


@pytest.mark.parametrize("parts", [3, 4096])
def test_groups_may_be_split(spark, monkeypatch, parts):
    monkeypatch.setattr(N, "GROUP_ROWS", parts)
    monkeypatch.setattr(N, "GROUP_QUERIES", parts)
    rows = [(k, [1.0, 2.0]) for k in range(30)] + [
        (100 + k, [float(np.float32(x)) for x in (math.cos(k), math.sin(k))]) for k in range(20)
    ]
    found, truth = search(spark, rows, 6), brute(rows, 6)
    assert {i: [j for j, _ in v] for i, v in found.items()} == {i: [j for j, _ in v] for i, v in truth.items()}


def test_blocks_of_lists(monkeypatch):
    monkeypatch.setattr(N, "GROUP_ROWS", 10)
    order, block = N.blocks_of_lists(np.array([[0.0], [3.0], [1.0], [2.0]]), np.array([4, 30, 5, 2]))
    if order[0] == 1:
        assert order.tolist() == [1, 3, 2, 0] and block.tolist() == [0, 1, 1, 2]
    else:
        assert order.tolist() == [0, 2, 3, 1] and block.tolist() == [0, 0, 1, 2]


def test_few_pairs_are_followed_alone(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 40)) * 20
    rows = [(k, (centres[k % 12] + rng.standard_normal(40)).tolist()) for k in range(600)]
    truth = brute(rows, 5)
    for few in (0.0, 1.0):
        monkeypatch.setattr(N, "FEW_PAIRS", few)
        found = search(spark, rows, 5)
        share = [len({j for j, _ in found[i]} & {j for j, _ in truth[i]}) / 5 for i in truth]
        assert found.keys() == truth.keys() and np.mean(share) > 0.95


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]),
        (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (10, [-1.0, 0.0]), (15, []),
    ]
    assert search(spark, rows, 20) == {0: [(1, 0.5), (10, -1.0)], 10: [(1, -0.5), (0, -1.0)]}
    assert search(spark, [(0, [1.0])], 20) == {}
    assert N.search(spark.createDataFrame([], SCHEMA), "vec_id", "embedding", asks()).collect() == []
    assert search(spark, [(5, None)], 20) == {}
