import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortweave.llm import substring as S


def brute(rows):
    docs = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in sorted(rows, key=lambda r: r[0])]
    first, out = {}, {}
    for i, w in docs:
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, w in docs:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_as_brute_force(documents, texts):
    found = S.remove_repeats(documents, "doc_id", "text").collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute(texts)


@pytest.mark.parametrize("bits", [2, 24])
def test_anchor_bits_change_no_result(spark, monkeypatch, bits):
    rows = [(k, " ".join(f"w{(j * (1 + k % 3)) % 40}" for j in range(k % 7, 40 + k))) for k in range(40)]
    if bits == 2:
        rows = rows[:12]
    monkeypatch.setattr(S, "ANCHOR_BITS", bits)
    monkeypatch.setattr(S, "CHUNK_BYTES", 500)
    monkeypatch.setattr(S, "BUCKET_BYTES", 700)
    found = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == brute(rows)


def test_repeated_rows_null_keys_and_nothing(spark, nothing):
    assert S.remove_repeats(nothing, "doc_id", "text").collect() == []
    long = " ".join(f"w{k}" for k in range(20))
    rows = [(5, long), (5, long), (None, long), (7, "x " + long + " y"), (None, None), (8, None), (-3, "q " * 12)]
    found = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in found) == [
        (-3, 12, 0), (0, 0, 0), (0, 20, 0), (5, 20, 0), (5, 20, 0), (7, 22, 20), (8, 0, 0),
    ]


def test_texts_and_other_columns(spark):
    long = " ".join(f"w{k}" for k in range(20))
    rows = [(1, long + "\n same", "a", None), (2, "x  " + long, "b", 3), (3, "left\tas it  is", "c", 4), (4, None, "d", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk string, rest int")
    found = S.remove_repeats(df, "doc_id", "text", with_text=True, carry=["chunk", "rest"]).orderBy("doc_id").collect()
    assert [(r.kept_text, r.chunk, r.rest) for r in found] == [
        (long + "\n same", "a", None), ("x", "b", 3), ("left\tas it  is", "c", 4), (None, "d", 5),
    ]


def test_packed_differences():
    for values in ([], [0], [5, 65534, 65535, 131070, 200_000, 16_777_215], list(range(1000))):
        packed = S.pack(np.array(values, np.int64))
        assert S.unpack(packed).tolist() == values


def test_documents_are_dealt_once(spark, documents):
    made = S.remove_repeats(documents.where(F.col("doc_id") < 20), "doc_id", "text")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
