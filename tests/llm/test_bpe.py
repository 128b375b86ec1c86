import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from cohortweave.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(own):
    ranks = {t: k for k, t in enumerate(own.vocabulary.tokens) if t}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rnd = random.Random(2)
    yield from ("", " ", "  a", " a  b \n c\t\t d ", "don't we'll I'M", "日本語 漢字", "😀😀 é", "<|endoftext|> x")
    yield from ("a" * 3000, " x   y\x1c z\x85 w  ", "tab\t x", "12 34  56", "a\u3000 b", "trail ", "ab" * 700)
    for _ in range(300):
        yield "".join(rnd.choice(" \n\tab,.é1'日 s") for _ in range(rnd.randrange(60)))
    for _ in range(30):
        yield "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(900)))


def test_ids_are_those_of_the_library_and_decode(own, reference):
    odd = list(odd_texts())
    for text, ids in zip(odd, own.encode(odd), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text)
        assert own.vocabulary.decode(ids) == text.encode()


def test_long_and_short_pieces_merge_alike(own):
    piece = b"".join(bytes([97 + k * k % 26]) for k in range(400))
    assert own.vocabulary.encode_pieces([piece])[0].tolist() == own.vocabulary._heap(piece).tolist()


def test_what_is_kept_does_not_change_ids(own, reference, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 3)
    for text in ["a b c d e f", "a b", "g h i j", "a b c d e f"] * 2:
        assert own.encode([text])[0].tolist() == reference.encode_ordinary(text)


def test_operator(documents, texts, nothing, reference):
    found = bpe.round_trip(documents, "doc_id", "text", RANKS, public_tokenizers.PATTERN).collect()
    assert len(found) == len(texts)
    for r in found:
        text = dict(texts)[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(nothing, "doc_id", "text", RANKS, public_tokenizers.PATTERN).collect() == []
    ids = {r.doc_id: r.ids for r in bpe.encode(documents, "doc_id", "text", RANKS, public_tokenizers.PATTERN).collect()}
    assert all(ids[i] == reference.encode_ordinary(t or "") for i, t in texts)
