import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortweave.llm import langid as L
from cohortweave.llm.queries import QUERIES, language_model


def test_held_out_accuracy(spark, sf_dir):
    found = QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(found) == len(truth)
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


@pytest.fixture(scope="module")
def model():
    texts = ["the cat and the dog with that hat"] * 20 + ["der hund und die katze mit dem hut"] * 20
    return L.fit(texts, ["en"] * 20 + ["de"] * 20)


def test_small_model(model):
    names, scores = model.predict(["the dog", "der Hund", "", "12 34 !?", "ÜBER DIE KATZE"])
    assert names == ["en", "de", L.UNKNOWN, L.UNKNOWN, "de"] and scores[2:4] == [0.0, 0.0]
    assert (model.weights != 0).mean() < 0.01  # sparse


def test_a_text_scores_the_same_among_others(model):
    alone = [model.predict([t])[1][0] for t in ("the dog", "x", "der hund")]
    assert np.allclose(alone, model.predict(["the dog", "x", "der hund"])[1])
    texts = ["ab", "İıß x", "", "a  b\n\nc1d"]
    points, offsets = L.code_points(texts)
    for k, t in enumerate(texts):
        assert points[offsets[k] : offsets[k + 1]].tolist() == L.code_points([t])[0].tolist()


def test_nothing_to_learn_from(spark, documents, nothing):
    assert L.sample(nothing, "doc_id", "text", "lang", F.lit(True)) == ([], [])
    model = L.fit([], [])
    assert model.predict(["text"]) == ([L.UNKNOWN], [0.0])
    assert {r.lang_pred for r in L.identify(documents, ["doc_id"], "text", model).collect()} == {L.UNKNOWN}


def test_sample_and_operator(spark, documents, texts, nothing, model):
    learn = F.col("doc_id") % 2 == 0
    taken, langs = L.sample(documents, "doc_id", "text", "lang", learn)
    expected = sorted((t, ["en", "de", None][i % 3]) for i, t in texts if i % 2 == 0 and i % 3 < 2 and t is not None)
    assert sorted(zip(taken, langs, strict=True)) == expected
    found = {r.doc_id: r for r in L.identify(documents, ["doc_id"], "text", model).collect()}
    assert len(found) == len(texts)
    for i, t in texts:
        assert (found[i].lang_pred == L.UNKNOWN) == (not any(c.isalpha() for c in t or ""))
    assert L.identify(nothing, ["doc_id"], "text", model).collect() == []


def test_rows_without_a_key_teach_nothing_but_are_identified(spark):
    schema = "doc_id long, text string, lang string"
    keyed = [(k, f"the cat and dog {k}" if k % 2 else f"der hund und katze {k}", "en" if k % 2 else "de") for k in range(40)]
    bare = [(None, "the cat and the dog", "en"), (None, "der hund", "xx"), (None, None, "de"), (None, "le chat", None)]
    docs = spark.createDataFrame(keyed + bare, schema)
    expected = L.sample(spark.createDataFrame(keyed, schema), "doc_id", "text", "lang", F.lit(True))
    assert len(expected[0]) == 40 and L.sample(docs, "doc_id", "text", "lang", F.lit(True)) == expected
    assert L.sample(spark.createDataFrame(bare, schema), "doc_id", "text", "lang", F.lit(True)) == ([], [])
    model = language_model(docs)
    assert model.languages == ("de", "en")
    found = L.identify(docs, ["doc_id"], "text", model).collect()
    assert len(found) == 44 and sum(r.doc_id is None for r in found) == 4
