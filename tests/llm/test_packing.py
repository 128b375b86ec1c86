import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortweave.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit(lengths):
    lengths = np.array(lengths, np.int64)
    bins = P.best_fit(lengths, 20)
    assert sorted(k for b in bins for k in b) == list(range(len(lengths)))
    assert all(lengths[b].sum() <= 20 for b in bins)
    # As in the plain form: every item into the fullest bin with room.
    rooms = []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fit = [r for r in rooms if r >= lengths[k]]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - lengths[k])
        else:
            rooms.append(20 - lengths[k])
    assert len(rooms) == len(bins)


def test_ids_are_those_of_the_tokenizers_library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    assert P.byte_level_ranks(PATH) is not None
    odd = ["", " ", "a  b \n c\t", "<|endoftext|> don't", "日本語 😀 é\u0301", "x" * 3000, "\x1c\x85\u00a0 z", "12 ½ Ⅷ"]
    odd += [f"a{chr(c)}b {chr(c)}. {chr(c)}\n" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for text, ids in zip(odd, P.tokens(PATH).encode(odd), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_other_files_are_run_by_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert P.byte_level_ranks(path) is None
    ids = next(P.Tokens(path).encode(["Some words"]))
    assert ids.tolist() == Tokenizer.from_file(path).encode("Some words", add_special_tokens=False).ids


def check(rows, texts, capacity, least):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in texts:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert sum(r.length for r in own) == len(ids) and len(own) == -(-len(ids) // capacity)
        assert all(r.length == capacity for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(filled) <= least * -(-sum(r.length for r in rows) // capacity) + 1


def test_every_piece_has_its_place(documents, texts, nothing):
    check(P.pack_documents(documents, "doc_id", "text", PATH).collect(), texts, 1024, 1.05)
    assert P.pack_documents(nothing, "doc_id", "text", PATH).collect() == []


def test_rounds_merge_what_tasks_leave(spark, texts, monkeypatch):
    monkeypatch.setattr(P, "TASK_ITEMS", 2)
    rows = spark.createDataFrame(texts * 1, "doc_id long, text string").repartition(40)
    found = P.pack_documents(rows, "doc_id", "text", PATH, capacity=128).collect()
    check(found, texts, 128, 1.05)


def test_repeated_rows_and_null_keys_are_packed(spark):
    rows = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    found = P.pack_documents(rows, "doc_id", "text", PATH).collect()
    assert sorted((r.doc_id or 0, r.length) for r in found) == [(0, 2), (1, 2), (1, 2), (2, 1)]
    assert len({r.sequence_id for r in found}) == 1 and len({r.offset for r in found}) == 4


def test_items_that_cannot_be_merged_end(spark, monkeypatch):
    monkeypatch.setattr(P, "TASK_ITEMS", 1)
    rows = spark.createDataFrame([(k, "w " * 40) for k in range(60)], "doc_id long, text string").repartition(7)
    found = P.pack_documents(rows, "doc_id", "text", PATH, capacity=80).collect()  # 42 ids each
    assert len({r.sequence_id for r in found}) == 60 and len(found) == 60
