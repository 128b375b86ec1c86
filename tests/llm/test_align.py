import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cohortweave.llm import align as A

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) from the libraries alone."""
    first = Tokenizer.from_file(BYTES)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in kept)}
    aligned, counts = [], Counter()
    for key, text in rows:
        whole = (" " + (text or "")).encode()
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        as_bytes = [bytes(of[c] for c in first.id_to_token(i)) for i in a]
        names = [second.id_to_piece(i) for i in b]
        bs_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, names)]
        if not text or b"".join(as_bytes) != whole or b"".join(bs_bytes) != whole:
            a, b, as_bytes, bs_bytes = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in as_bytes]), np.cumsum([len(x) for x in bs_bytes])
        groups = []
        low = 0
        for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            groups.append(tuple([i for i, e in zip(ids, ends) if low < e <= end] for ids, ends in ((a, ends_a), (b, ends_b))))
            low = end
        links = [(x, y) for x, e in zip(a, ends_a) for y, f in zip(b, ends_b) if e == f]
        counts.update(links)
        aligned.append((key, a, b, groups, links))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for key, a, b, groups, links in aligned:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(counts[p] == top[p[1]] for p in links)
        sha = hashlib.sha256(said.encode()).hexdigest() if a else ""
        out.append((key, len(a), len(b), len(groups), len(links), best, sum(counts[p] for p in links), sha))
    return out


def values(df):
    return [(r[0], r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()]


def test_groups_are_the_common_ends():
    rnd = random.Random(1)
    for _ in range(5000):
        n = rnd.randrange(1, 60)
        a = sorted({*[rnd.randrange(n) for _ in range(rnd.randrange(n))], n})
        b = sorted({*[x for x in a if rnd.random() < 0.9], *[rnd.randrange(n) for _ in range(rnd.randrange(3))], n})
        first, second = A.group_ends(np.array(a), np.array(b))
        common = sorted(set(a) & set(b))
        assert [a[i] for i in first] == common == [b[j] for j in second]


def test_long_stretches_are_jumped():
    ends = list(range(1, 100_001))
    assert A.common_ends(ends, ends) == ([(0, 0, 100_000)], [])
    assert A.common_ends([1, 2, 5, 7, 9], [1, 2, 3, 5, 9]) == ([(0, 0, 2)], [(2, 3), (4, 4)])
    assert A.common_ends([], []) == ([], [])


@pytest.fixture(scope="module")
def short(texts):
    """The shared texts without the longest, whose brute force takes too long, and some odd ones."""
    odd = ["▁", "a▁b", " ", "  ", "\n\n a", "日本語 😀 é", "<|endoftext|> <s>", "a  b   c", "don't 12345", "ﬁ½\x00"]
    return [(i, t) for i, t in texts if not t or len(t) < 2500] + [(1000 + k, t) for k, t in enumerate(odd)]


def test_operator_equals_brute_force(spark, short):
    rows = [*short, short[20], short[20], (None, "a b c"), (None, None)]
    schema = "doc_id long, text string, block long, links int, column string, pair int"
    docs = spark.createDataFrame([(*r, 1, 2, "c", 3) for r in rows], schema).repartition(4)
    assert sorted(values(A.align(docs, "doc_id", "text", BYTES, PIECES)), key=str) == sorted(brute(rows), key=str)


def test_blocks_do_not_matter(spark, short, monkeypatch):
    docs = spark.createDataFrame(short, "doc_id long, text string")
    whole = sorted(values(A.align(docs.coalesce(1), "doc_id", "text", BYTES, PIECES)))
    parts = sorted(values(A.align(docs.repartition(7), "doc_id", "text", BYTES, PIECES)))
    assert whole == parts


def test_long_text_and_empty_table(spark, texts, nothing):
    assert A.align(nothing, "doc_id", "text", BYTES, PIECES).collect() == []
    long = max((t for _, t in texts if t), key=len) * 3
    (found,) = A.align(spark.createDataFrame([(1, long)], "doc_id long, text string"), "doc_id", "text", BYTES, PIECES).collect()
    own = A.pair(BYTES, PIECES)
    ((a, b),) = own.tokens([long])
    common = np.intersect1d(np.cumsum(own.lengths[a]), np.cumsum(own.second.lengths[b]))
    assert (found.n_a, found.n_b, found.n_groups) == (len(a), len(b), len(common))
    only_empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert values(A.align(only_empty, "doc_id", "text", BYTES, PIECES)) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2)]
