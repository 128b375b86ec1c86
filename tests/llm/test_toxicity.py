import random

import numpy as np
import pyarrow as pa
import pytest

from cohortweave.llm import toxicity as T

BAD = ["loathsome", "vermin", "wretch", "imbecile", "filthy"]


def corpus(n, seed):
    rnd = random.Random(seed)
    parts = "ka lo mi ren tas ver ul don pe sha gri".split()
    for k in range(n):
        words = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(30, 200))]
        if toxic := k % 3 == 0:
            for _ in range(4):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        yield " ".join(words), int(toxic)


@pytest.fixture(scope="module")
def model():
    rows = list(corpus(900, 1))
    return T.fit([t.encode() for t, _ in rows], [y for _, y in rows])


def test_held_out_texts(model):
    pair = model.compressors()
    rows = [(model.score(T.saving(t.encode(), pair)) >= 0.7, y) for t, y in corpus(300, 2)]
    assert np.mean([p for p, y in rows if y]) > 0.9
    assert np.mean([p for p, y in rows if not y]) < 0.05


def test_probabilities_rise_and_windows_cover(model):
    assert all(a <= b for a, b in zip(model.probability, model.probability[1:], strict=False))
    words = [b"w%d" % k for k in range(200)]
    windows = T.cut(b" ".join(words))
    assert all(0 < len(w) <= T.WINDOW for w in windows)
    assert {w for part in windows for w in part.split()} >= set(words)
    assert T.cut(b"") == [] and b"".join(T.cut(b"x" * 500)) == b"x" * 500
    mixed = b"a b " * 5 + b"c" * 100
    assert sum(map(len, T.cut(mixed))) >= len(mixed)


def test_a_model_of_one_class_finds_nothing():
    model = T.fit([b"some text here"] * 5, [0] * 5)
    assert model.score(T.saving(b"some text", model.compressors())) == 0.0
    assert T.fit([], []).score(40) == 0.0


def test_white_space_and_case_do_not_matter():
    data = np.frombuffer(b"A\tb\nC\xc3\x84", np.uint8)
    assert T.normalized(data).tobytes() == b"a b c\xc3\x84"


def test_operator(spark, documents, texts, nothing, model):
    found = T.score(documents, ["doc_id"], "text", model).collect()
    assert len(found) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    by = {r.doc_id: r.score for r in found}
    assert len({by[i] for i, t in texts if not (t or "").strip()}) == 1
    assert T.score(nothing, ["doc_id"], "text", model).collect() == []
    rows = spark.createDataFrame([(None, " ".join(BAD)), (2, None)], "doc_id long, text string")
    assert [(r.doc_id, r.predicted) for r in T.score(rows, ["doc_id"], "text", model).collect()] == [(None, 1), (2, 0)]


def test_sample_takes_labelled_rows_that_may_be_learnt_from(spark, documents, texts, nothing):
    from pyspark.sql import functions as F

    labels = [(i, i % 2, 0) for i, _ in texts] + [(None, 1, 0), (10_000, 1, 1), (4, 1, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    taken, y = T.sample(documents, labels, "doc_id", "text", "toxic", F.col("doc_id") < 10)
    known = {T.normalized(np.frombuffer((t or "").encode(), np.uint8)).tobytes() for i, t in texts if i < 10 and t}
    assert set(taken) <= known | {b""} and len(taken) == len(y)
    assert T.sample(nothing, labels, "doc_id", "text", "toxic", F.lit(True)) == ([], [])
    assert T.sample(documents, labels.limit(0), "doc_id", "text", "toxic", F.lit(True)) == ([], [])


def test_slices_of_arrow_strings_keep_their_place(model):
    column = pa.array(["x", " ".join(BAD), None, "y"])
    assert column.slice(1, 2).to_pylist()[0] == " ".join(BAD)
