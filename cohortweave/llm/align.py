"""Alignment of two tokenizations of the same bytes by diagonal run skipping.

Both tokenizers' tokens end at byte offsets. Where the next tokens of both end alike, the two end
arrays run side by side at one index shift: exponential probing finds how far, and the stretch is
taken as one-to-one groups at once. Where they part, the lists are walked to the next common end;
that is one irregular group, and it changes the shift.

Texts are aligned in blocks. A block keeps its distinct linked id pairs and, for every document,
how often it has which of them, so that only distinct pairs of blocks meet the corpus-wide counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.llm.packing import Tokens, byte_level_ranks
from cohortweave.llm.sentence_pieces import Pieces
from cohortweave.llm.words import slices
from cohortweave.session import materialize

#: Bytes of text in a block (a longer text is a block of its own).
BLOCK_BYTES = 2 << 20
#: Tokens compared by the first probe after an irregular group; further ones double.
PROBE = 4


def common_ends(a: list[int], b: list[int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Groups of two ascending lists that end with the same value.

    One-to-one stretches (i, j, n) say that a[i + k] and b[j + k] are a group each, for k < n;
    irregular groups are the (i, j) of their last tokens.

    >>> common_ends([1, 2, 5, 7, 9], [1, 2, 3, 5, 9])
    ([(0, 0, 2)], [(2, 3), (4, 4)])
    """
    stretches, irregular = [], []
    i = j = 0
    n, m = len(a), len(b)
    while i < n:
        # Probe PROBE, 2 PROBE, 4 PROBE, ... tokens ahead at the shift j - i.
        start, width = i, PROBE
        while i < n and a[i : i + width] == b[j : j + width]:
            step = min(width, n - i)
            i, j, width = i + step, j + step, 2 * width
        # They part within the last probe, or the end is reached: halve down to the place.
        while width > 1 and i < n:
            width //= 2
            if a[i : i + width] == b[j : j + width]:
                step = min(width, n - i)
                i, j = i + step, j + step
        if i > start:
            stretches.append((start, j - (i - start), i - start))
        if i >= n or j >= m:
            break
        # Locally, to the next end that both have.
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        irregular.append((i, j))
        i, j = i + 1, j + 1
    return stretches, irregular


def group_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``a`` and ``b`` of the last tokens of every group, ascending."""
    stretches, irregular = common_ends(a.tolist(), b.tolist())
    if stretches:
        i, j, n = np.array(stretches, np.int64).T
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first, second = np.repeat(i, n) + within, np.repeat(j, n) + within
    else:
        first = second = np.zeros(0, np.int64)
    odd = np.array(irregular, np.int64).reshape(-1, 2)
    return np.sort(np.concatenate([first, odd[:, 0]])), np.sort(np.concatenate([second, odd[:, 1]]))


class Pair:
    """The two tokenizers, and the bytes of their tokens."""

    def __init__(self, byte_level: str, piece_model: str):
        ranks = byte_level_ranks(byte_level)
        if ranks is None:
            raise ValueError("the first tokenizer must be a byte-level one")
        self.first, self.second = Tokens(byte_level), Pieces(piece_model)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, k in ranks.items():
            tokens[k] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.decimal = {
            end: np.array([b"%d%s" % (k, end) for k in range(max(size, self.second.size))], object)
            for end in (b",", b"|", b";")
        }

    def first_bytes(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.starts[ids] - (ends - lengths), lengths)]

    def tokens(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for every text; none where the joined bytes of one are not a space and the text."""
        empty = np.zeros(0, np.int64)
        first = self.first.encode([" " + t for t in texts])
        for text, a, b in zip(texts, first, self.second.encode(texts), strict=True):
            a, b, bytes_ = a.astype(np.int64), b.astype(np.int64), (" " + text).encode()
            same = text and self.first_bytes(a).tobytes() == bytes_ and self.second.joined(b) == bytes_
            yield (a, b) if same else (empty, empty)


@lru_cache(maxsize=2)
def pair(byte_level: str, piece_model: str) -> Pair:
    """One per worker process."""
    return Pair(byte_level, piece_model)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


class Block:
    """Some texts aligned: per text the numbers of tokens and groups, the groups' text, and the links."""

    def __init__(self, own: Pair, texts: list[str]):
        found = list(own.tokens(texts))
        self.n_a = np.array([len(a) for a, _ in found], np.int64)
        self.n_b = np.array([len(b) for _, b in found], np.int64)
        self.a = np.concatenate([np.zeros(0, np.int64), *[a for a, _ in found]])
        self.b = np.concatenate([np.zeros(0, np.int64), *[b for _, b in found]])
        # Texts stand one behind the other: both end where a text ends.
        ends = np.cumsum(own.lengths[self.a]), np.cumsum(own.second.lengths[self.b])
        self.last_a, self.last_b = group_ends(*ends)
        self.group_starts = np.searchsorted(self.last_a, _starts(self.n_a))
        self.decimal = own.decimal

    def n_groups(self) -> np.ndarray:
        return np.diff(self.group_starts)

    def groups_text(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every text."""
        out = np.empty(len(self.a) + len(self.b), object)
        for ids, last, other, end in (
            (self.a, self.last_a, np.concatenate([[0], self.last_b + 1]), b"|"),
            (self.b, self.last_b, self.last_a + 1, b";"),
        ):
            group = np.searchsorted(last, np.arange(len(ids)))
            out[np.arange(len(ids)) + other[group]] = self.decimal[b","][ids]
            out[last + other[: len(last)]] = self.decimal[end][ids[last]]
        at = _starts(self.n_a + self.n_b)
        return [b"".join(out[x:y].tolist())[:-1] for x, y in zip(at[:-1], at[1:], strict=True)]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (A id << 32 | B id), how often each, and per text from where which of them how often."""
        distinct, which = np.unique((self.a[self.last_a] << 32) | self.b[self.last_b], return_inverse=True)
        texts = np.repeat(np.arange(len(self.n_a)), self.n_groups())
        cells, times = np.unique(texts * max(1, len(distinct)) + which, return_counts=True)
        text, column = np.divmod(cells, max(1, len(distinct)))
        starts = np.searchsorted(text, np.arange(len(self.n_a) + 1))
        return distinct, np.bincount(which, minlength=len(distinct)), starts, column, times


_BLOCK = (
    "doc_ids array<{key}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, groups_sha256 array<string>, "
    "pairs array<bigint>, pair_links array<bigint>, starts array<bigint>, columns array<int>, times array<int>"
)
_DOC = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def align(documents: DataFrame, key: str, text: str, byte_level: str, piece_model: str) -> DataFrame:
    """Per document n_a, n_b (tokens), n_groups, n_links, n_best, count_sum, groups_sha256.

    A link is a pair of tokens that end together; n_best counts the links whose id pair is a most
    frequent one of its B id over all documents (ties included), count_sum adds up the pairs' numbers
    of links. Null and empty texts, and those whose joined token bytes differ from a space and the text
    (such as texts with the marker U+2581), have no tokens: zeros, and '' for groups_sha256. Repeated
    rows count and are returned each, also without a key; an empty table gives no rows; other columns
    are ignored. A text of any length is aligned whole.
    """
    kind = documents.schema[key].dataType.simpleString()

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pair(byte_level, piece_model)
        for batch in batches:
            for at, n in slices(batch.column(1), BLOCK_BYTES):
                part = batch.slice(at, n)
                made = Block(own, part.column(1).fill_null("").to_pylist())
                shas = [hashlib.sha256(g).hexdigest() if g else "" for g in made.groups_text()]
                pairs, links, starts, columns, times = made.links()
                rows = [part.column(0), made.n_a, made.n_b, made.n_groups(), shas, pairs, links, starts]
                arrays = [pa.array(x) for x in rows] + [pa.array(x.astype(np.int32)) for x in (columns, times)]
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in arrays],
                    names=[c.split()[0] for c in _BLOCK.split(", ")],
                )

    rows = documents.select(F.col(key), F.col(text).cast("string")).mapInArrow(block, _BLOCK.format(key=kind))
    # Any numbers do, as they are given once and stored.
    blocks = materialize(rows.withColumn("block", F.monotonically_increasing_id()))

    own_pairs = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "pair_links")).alias("column", "p")).select(
        "block", "column", F.col("p.pairs").alias("pair"), F.col("p.pair_links").alias("n")
    )
    counts = own_pairs.groupBy("pair").agg(F.sum("n").alias("links"))
    # At most as many pairs share a B id as A has ids.
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    counts = materialize(counts.select("pair", "links", (F.col("links") == F.max("links").over(of_b)).alias("best")))
    known = (
        own_pairs.join(counts, "pair")
        .groupBy("block")
        .agg(F.array_sort(F.collect_list(F.struct("column", "links", "best"))).alias("k"))
        .select(F.col("block").alias("of"), F.col("k.links").alias("links"), F.col("k.best").alias("best"))
    )
    whole = blocks.drop("pairs", "pair_links").join(known, F.col("block") == F.col("of"), "left")
    whole = whole.select("doc_ids", "n_a", "n_b", "n_groups", "groups_sha256", "starts", "columns", "times", "links", "best")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                c = {n: batch.column(n).slice(k, 1).flatten() for n in batch.schema.names}
                column, times, starts = (c[n].to_numpy() for n in ("columns", "times", "starts"))
                links = c["links"].to_numpy()[column] * times if len(column) else np.zeros(0, np.int64)
                best = times * c["best"].to_numpy(zero_copy_only=False)[column] if len(column) else links
                sums = [np.diff(_starts(x)[starts]) for x in (best, links)]
                made = [c["n_a"], c["n_b"], c["n_groups"], c["n_groups"], *map(pa.array, sums), c["groups_sha256"]]
                yield pa.RecordBatch.from_arrays(
                    [c["doc_ids"], *made], names=[key, *[x.split()[0] for x in _DOC.split(", ")]]
                )

    return whole.mapInArrow(tell, f"`{key}` {kind}, {_DOC}")


__all__ = ["Block", "Pair", "align", "common_ends", "group_ends"]
