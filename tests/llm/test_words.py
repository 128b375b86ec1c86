import re

import numpy as np
import pyarrow as pa

from cohortweave.llm.chunks import chunks
from cohortweave.llm.words import inside, slices, windows, words_of


def test_words_are_those_of_the_pattern(texts):
    column = pa.array([t for _, t in texts])
    words = words_of(column)
    expected = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in texts]
    assert words.counts().tolist() == [len(w) for w in expected]
    raw = words.data.tobytes()
    found = [raw[a:b] for a, b in zip(words.starts, words.ends, strict=True)]
    assert found == [w for row in expected for w in row]
    assert len(set(words.hashes.tolist())) == len(set(found))


def test_hashes_do_not_depend_on_the_place():
    a, b = words_of(pa.array(["p q r s t"])), words_of(pa.array(["x", "p q", "r s t"]))
    assert a.hashes.tolist() == b.hashes[1:].tolist()
    assert windows(a.hashes, 3)[2] == windows(b.hashes, 3)[3]
    assert inside(b.text, 2).tolist() == [False, True, False, True, True]
    assert not len(words_of(pa.array([None, ""])).hashes)
    assert not len(words_of(pa.array([], pa.string())).hashes)
    assert windows(np.zeros(3, np.uint64), 4).tolist() == []


def test_lower_case_is_ascii_only():
    words = words_of(pa.array(["ABC abc Ä ä"]), lower=True)
    assert words.hashes[0] == words.hashes[1] and words.hashes[2] != words.hashes[3]


def test_slices_cover_all_rows():
    column = pa.array(["a" * 10, None, "", "b" * 100, "c"])
    assert list(slices(column, 20)) == [(0, 3), (3, 1), (4, 1)]


def test_chunks_join_to_the_text(texts):
    for text in [t for _, t in texts if t] + ["  a", "a  b", " a \n b ", "\x1c x", "a "]:
        assert "".join(chunks(text)) == text
