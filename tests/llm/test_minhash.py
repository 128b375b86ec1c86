import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortweave.llm import minhash
from cohortweave.llm.components import components


def groups(rows, size=2):
    """By brute force: (n_shingles, component_id) of every doc_id."""
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        runs = [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
        sets[i] = frozenset(runs if len(w) >= size else [tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    posted = defaultdict(list)
    for i in sorted(sets):
        for j, n in Counter(j for s in sets[i] for j in posted[s]).items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            posted[s].append(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_groups_are_those_of_brute_force(documents, texts, size):
    found = minhash.near_duplicates(documents, "doc_id", "text", size).collect()
    assert len(found) == len(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == groups(texts, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


@pytest.mark.parametrize("few", [0, 16, 10_000])
def test_a_hot_group_of_near_copies(spark, monkeypatch, few):
    """However many members outside a component meet it directly, and however many by a pivot."""
    monkeypatch.setattr(minhash, "FEW", few)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(400):
        words = list(base)
        for k in range(i % 30):
            words[(i * 37 + k * 11) % 300] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == groups(rows)


@pytest.mark.parametrize("rounds", [0, 2])
def test_families_beside_a_hot_group(spark, monkeypatch, rounds):
    """Families that share most of a hot group's words, found with and without rounds before the last step."""
    monkeypatch.setattr(minhash, "FEW", 0)
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(150):
        family = i % 5
        words = base + [f"f{family}_{k}" for k in range(60 * (family > 0))]
        for k in range(i % 12):
            words[(i * 37 + k * 11) % len(words)] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == groups(rows)


def test_members_of_a_list_that_cannot_agree_do_not_meet(spark, monkeypatch):
    """Texts that share a part of many others' words are not paired with all of them."""
    monkeypatch.setattr(minhash, "FEW", 0)
    agreeing, met = minhash._agreeing, []

    def counted(pairs, classes):
        met.append(pairs.count())
        return agreeing(pairs, classes)

    monkeypatch.setattr(minhash, "_agreeing", counted)
    rows = []
    for i in range(120):
        # Five passages in three versions each: many share most lists, few are nearly alike.
        versions = [i * 7 // 3**k % 3 for k in range(5)]
        rows.append((i, " ".join(f"p{k}_{v}_{n}" for k, v in enumerate(versions) for n in range(40))))
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == groups(rows)
    assert met[0] and met[-1] <= 4 * len(rows), met


def test_marks_leave_all_pairs_that_agree(spark):
    """Marks say no only of pairs with too few equal coordinates."""
    rng, rows = np.random.default_rng(3), []
    for i in range(200):
        one = rng.integers(-(2**31), 2**31, minhash.COORDINATES)
        other = np.where(rng.random(minhash.COORDINATES) < rng.random(), one, rng.integers(-(2**31), 2**31, minhash.COORDINATES))
        rows.append((i, one.tolist(), other.tolist(), int((one == other).sum())))
    pairs = spark.createDataFrame(rows, "i long, a array<int>, b array<int>, same int")
    marked = lambda c: F.struct(F.lit(10).alias("n"), minhash._marks(F.col(c)).alias("marks"))
    told = pairs.select("same", marked("a").alias("x"), marked("b").alias("y")).select("same", minhash._may_agree("x", "y").alias("may"))
    told = told.collect()
    assert all(r.may for r in told if r.same >= minhash.MATCHES)
    assert not any(r.may for r in told if r.same < minhash.MATCHES // 2)


def test_repeated_rows_null_keys_and_nothing(spark, nothing):
    assert minhash.near_duplicates(nothing, "doc_id", "text").collect() == []
    rows = [(3, "a b c"), (3, "a b c"), (None, "a b c"), (5, "A b  c"), (None, None), (7, None), (8, "")]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    out = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in found.collect())
    assert out == [
        (0, 0, None, True), (0, 2, None, True), (3, 2, 3, True), (3, 2, 3, True),
        (5, 2, 3, False), (7, 0, 7, True), (8, 0, 8, True),
    ]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 200)], "a long, b long")
    found = {r.node: r.label for r in components(edges, "a", "b").collect()}
    assert found == {k: 0 for k in range(51)} | {100: 100, 200: 100}
