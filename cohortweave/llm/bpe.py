"""Byte-level BPE encoding and decoding with numpy matrices.

Pieces of similar length stand in one padded matrix of ids. In each round every row merges its
leftmost pair of the smallest rank; pair ranks come from an open-addressed hash table, rows are
closed up after the merge, and rows without a pair leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cohortweave.llm.chunks import chunks
from cohortweave.llm.words import map_texts

NONE = np.int32(1 << 30)
#: Chunks kept per worker process, and the longest of them.
KEPT, KEPT_LENGTH = 250_000, 64
#: Longer pieces are merged one at a time with a heap; a padded row would move its whole rest each round.
LONG_PIECE = 512
#: Cells of one matrix.
CELLS = 1 << 18


class Vocabulary:
    """Ranks as read from a file of lines ``base64-token rank``."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.decimal = [str(k) for k in range(self.size)]
        self.of_byte = np.full(256, -1, np.int32)
        for b in range(256):
            self.of_byte[b] = ranks.get(bytes([b]), -1)
        if (self.of_byte < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pairs = {
            (ranks[t[:k]] << 32) | ranks[t[k:]]: rank
            for t, rank in ranks.items()
            for k in range(1, len(t))
            if t[:k] in ranks and t[k:] in ranks
        }
        self.pairs = pairs
        bits = max(4, (4 * len(pairs) - 1).bit_length())
        self.shift, mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        left = np.fromiter(pairs, np.int64, len(pairs))
        rank = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot, self.probes = self._slot(left), 0
        while len(left):
            self.probes += 1
            at, first = np.unique(slot, return_index=True)
            free = first[self.keys[at] < 0]
            self.keys[slot[free]], self.values[slot[free]] = left[free], rank[free]
            rest = np.ones(len(left), bool)
            rest[free] = False
            left, rank, slot = left[rest], rank[rest], (slot[rest] + 1) & mask
        self.mask = mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where it is no token (or an id is negative)."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of every piece; each is encoded by itself."""
        out: list = [None] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            longest = int(lengths[order[at]])
            if longest > LONG_PIECE:
                out[order[at]] = self._heap(pieces[order[at]])
                at += 1
                continue
            # A bucket: lengths up to a quarter above its shortest, so that little is padding.
            most = min(LONG_PIECE, longest + longest // 4)
            to = int(np.searchsorted(lengths[order], most, side="right"))
            to = min(to, at + max(1, CELLS // max(1, most)))
            for k, ids in zip(order[at:to], self._matrix([pieces[k] for k in order[at:to]], most), strict=True):
                out[k] = ids
            at = to
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        n, width = len(pieces), max(2, width)
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        lengths = np.array([len(p) for p in pieces])
        columns = np.arange(width)
        ids = np.where(columns < lengths[:, None], self.of_byte[flat], -1).astype(np.int32)
        ranks = np.full((n, width), NONE, np.int32)
        ranks[:, :-1] = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        row, out = np.arange(n), [None] * n
        while True:
            best = ranks.argmin(axis=1)  # the leftmost of the smallest
            every = np.arange(len(best))
            merged = ranks[every, best]
            done = merged == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    line = ids[k]
                    out[row[k]] = line[line >= 0].copy()
                keep = ~done
                if not keep.any():
                    return out
                ids, ranks, row, best, merged = ids[keep], ranks[keep], row[keep], best[keep], merged[keep]
                every = np.arange(len(best))
            # Close up: what stands right of the pair moves one place to the left.
            right = columns[:-1] > best[:, None]
            ids[:, :-1] = np.where(right, ids[:, 1:], ids[:, :-1])
            ranks[:, :-1] = np.where(right, ranks[:, 1:], ranks[:, :-1])
            ids[:, -1], ranks[:, -1] = -1, NONE
            ids[every, best] = merged
            after = np.minimum(best + 1, ids.shape[1] - 1)
            ranks[every, best] = np.where(after > best, self.rank(ids[every, best], ids[every, after]), NONE)
            inner = np.flatnonzero(best > 0)
            before = best[inner] - 1
            ranks[inner, before] = self.rank(ids[inner, before], ids[inner, best[inner]])
            used = int((ids >= 0).sum(axis=1).max())
            if 2 <= used < ids.shape[1]:
                ids, ranks, columns = ids[:, :used].copy(), ranks[:, :used].copy(), columns[:used]

    def _heap(self, piece: bytes) -> np.ndarray:
        ids = [int(self.of_byte[b]) for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pairs
        heap = [(r, k) for k in range(n - 1) if (r := pairs.get((ids[k] << 32) | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            j = after[k] if ids[k] >= 0 else n
            if j >= n or pairs.get((ids[k] << 32) | ids[j]) != rank:
                continue
            ids[k], ids[j] = rank, -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if (r := pairs.get((rank << 32) | ids[after[k]])) is not None:
                    heapq.heappush(heap, (r, k))
            if (b := before[k]) >= 0 and (r := pairs.get((ids[b] << 32) | rank)) is not None:
                heapq.heappush(heap, (r, b))
        return np.array([x for x in ids if x >= 0], np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ``ids``, gathered from the table of all tokens."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.bytes[np.arange(total) + shift].tobytes()


class Encoder:
    """Texts to ids: cut by ``pattern``, every match encoded by itself."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(path)
        self.pattern = regex.compile(pattern)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [chunks(t) for t in texts]
        asked = set().union(*cut)
        new = list(asked.difference(self.kept).difference(self.older))
        findall = self.pattern.findall
        # A space and letters are one match of the pattern.
        matches = [(c,) if c[1:].isalpha() and c[0] == " " else findall(c) for c in new]
        distinct = {m: k for k, m in enumerate(set().union(*matches))}
        encoded = [ids.tobytes() for ids in self.vocabulary.encode_pieces([m.encode() for m in distinct])]
        ids_of = {
            c: b"".join([encoded[distinct[m]] for m in row]) for c, row in zip(new, matches, strict=True)
        }
        keep = {c: ids for c, ids in ids_of.items() if len(c) <= KEPT_LENGTH}
        for c in asked.difference(new):
            ids_of[c] = keep[c] = self.kept[c] if c in self.kept else self.older[c]
        out = [np.frombuffer(b"".join(map(ids_of.__getitem__, row)), np.int32) for row in cut]
        self.kept.update(keep)
        if len(self.kept) > KEPT:  # what the next texts do not ask for goes with `older`
            self.older, self.kept = self.kept, {}
        return out


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One per worker process."""
    return Encoder(path, pattern)


def encode(documents: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """``key`` and ``ids`` (array of int), one row per document; null or empty text: no ids.

    Repeated rows and null keys stay; other columns are ignored.
    """

    def work(texts: pa.Array) -> list:
        return [encoder(path, pattern).encode(texts.fill_null("").to_pylist())]

    return map_texts(documents, [key], text, "ids array<int>", work)


def round_trip(documents: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """``key``, n_tokens and the SHA-256 of the decimal ids and of the bytes decoded from the ids.

    ``encode`` and ``decode`` in one pass, so that ids do not leave the task.
    """

    def work(texts: pa.Array) -> list:
        own = encoder(path, pattern)
        table = own.vocabulary
        n, of_ids, of_bytes = [], [], []
        for ids in own.encode(texts.fill_null("").to_pylist()):
            n.append(len(ids))
            joined = " ".join(map(table.decimal.__getitem__, ids.tolist()))
            of_ids.append(hashlib.sha256(joined.encode()).hexdigest())
            of_bytes.append(hashlib.sha256(table.decode(ids)).hexdigest())
        return [n, of_ids, of_bytes]

    return map_texts(documents, [key], text, "n_tokens long, ids_sha256 string, decoded_sha256 string", work)


__all__ = ["Encoder", "Vocabulary", "encode", "encoder", "round_trip"]
