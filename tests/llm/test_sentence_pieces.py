import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from cohortweave.llm import sentence_pieces as S

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "a", "b", "th", "e", "\n", "\t", "1", "é", "日", "▁", "😀", "x", "\x00", "<s>", "ing", ".", " the", "'"]


@pytest.fixture(scope="module")
def own():
    return S.Pieces(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts():
    rnd = random.Random(2)
    yield from ("", " ", "▁", "▁▁ ▁", "a" * 3000, "日本" * 2000, "<0x41> <unk> </s>", "a　b", "trail ", "<|endoftext|>")
    yield from (" " * k + "a" + " " * (k // 2) for k in range(60))
    for _ in range(2000):
        yield "".join(rnd.choice(PARTS) for _ in range(rnd.randrange(40)))


def test_ids_are_those_of_the_library_and_decode(own, library):
    odd = list(odd_texts())
    for text, ids, expected in zip(odd, own.encode(odd), library.encode(odd), strict=True):
        assert ids.tolist() == expected, text
        assert own.decode(np.array([1, *expected, 2])) == library.decode([1, *expected, 2])


def test_any_ids_decode_as_the_library_does(own, library):
    rnd = random.Random(4)
    for _ in range(3000):
        kinds = [0, 1, 2, rnd.randrange(3, 259), rnd.randrange(259, 400), rnd.randrange(32000)]
        ids = [rnd.choice(kinds) for _ in range(rnd.randrange(9))]
        assert own.decode(np.array(ids, np.int64)) == library.decode(ids), ids


def test_chunks_join_to_the_marked_text():
    for text in odd_texts():
        marked = " " + text.replace("▁", " ") if text else ""
        assert "".join(" " + c for c in S.chunks(text)) == marked


def test_side_by_side_and_one_by_one_segment_alike(own):
    rnd = random.Random(6)
    cut = ["▁" + "".join(rnd.choice("abcdefgthing日é1.") for _ in range(rnd.randrange(S.SHORT))) for _ in range(500)]
    cut += ["▁" * k for k in range(1, 60)]
    for chunk, ids in zip(cut, own.segment_all(cut), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == own.segment(chunk)


def test_what_is_kept_does_not_change_ids(own, library, monkeypatch):
    monkeypatch.setattr(S, "KEPT", 3)
    for text in ["a b c d e f", "a b", "g h i j", "a b c d e f"] * 2:
        assert own.encode([text])[0].tolist() == library.encode(text)


def test_operator(documents, texts, nothing, library):
    found = S.round_trip(documents, "doc_id", "text", MODEL).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(dict(texts)[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert S.round_trip(nothing, "doc_id", "text", MODEL).collect() == []
    ids = {r.doc_id: r.ids for r in S.encode(documents, "doc_id", "text", MODEL).collect()}
    assert all(ids[i] == library.encode(t or "", add_bos=True, add_eos=True) for i, t in texts)


def test_repeated_rows_and_rows_without_a_key_stay(spark, library):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (None, None), (2, "")]
    found = S.encode(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", MODEL).collect()
    made = sorted((str(r.doc_id), r.ids) for r in found)
    assert made == sorted((str(i), library.encode(t or "", add_bos=True, add_eos=True)) for i, t in rows)
