"""SentencePiece BPE encoding and decoding through a table of distinct chunks.

Spaces become the marker U+2581, and one stands in front of every text. No piece of the model has a
marker behind another character, so no merge reaches over a place where a run of markers begins:
there a text is cut into chunks. Each distinct chunk is segmented once, and a text's ids are those
of its chunks, joined by position.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from cohortweave.llm.words import map_texts

MARKER = "▁"
#: Chunks kept per worker process, and the longest of them.
KEPT, KEPT_LENGTH = 400_000, 48
#: Chunks of up to so many characters are segmented side by side, so many cells at once.
SHORT, CELLS = 64, 1 << 18
NONE = np.int32(1 << 30)

_RUNS = re.compile(" *[^ ]+| +")


def _one_by_one(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("cohortweave_byte", _one_by_one)


def chunks(text: str) -> list[str]:
    """Chunks of a text with spaces for markers, each without its first marker.

    >>> chunks("one two  three ")
    ['one', 'two', ' three', '']
    """
    if not text:
        return []
    if MARKER in text:
        text = text.replace(MARKER, " ")
    if "  " in text or text[0] == " ":
        return [c[1:] for c in _RUNS.findall(" " + text)]
    return text.split(" ")


class PairTable:
    """Order and id of what two neighbouring pieces make, in an open-addressed hash table."""

    def __init__(self, pairs: dict[int, tuple[int, int]]):
        bits = max(4, (4 * len(pairs) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.order = np.full(1 << bits, NONE, np.int32)
        self.made = np.zeros(1 << bits, np.int32)
        self.probes = 1
        keys = np.fromiter(pairs, np.int64, len(pairs))
        for key, slot in zip(keys.tolist(), self._slot(keys).tolist(), strict=True):
            steps = 1
            while self.keys[slot] >= 0:
                slot, steps = (slot + 1) & self.mask, steps + 1
            self.keys[slot], (self.order[slot], self.made[slot]) = key, pairs[key]
            self.probes = max(self.probes, steps)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order (NONE: no piece) and id; negative ids are in no pair."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        found = self.keys[slot]
        open_ = np.flatnonzero((found != keys) & (found != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            found[open_] = self.keys[slot[open_]]
            open_ = open_[(found[open_] != keys[open_]) & (found[open_] != -1)]
        hit = found == keys
        return np.where(hit, self.order[slot], NONE), np.where(hit, self.made[slot], 0)


class Pieces:
    """A BPE model whose pieces cannot cross a marker, read by the sentencepiece library."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        self.ids: dict[str, int] = {}
        scores: dict[str, float] = {}
        self.byte = [self.unknown] * 256
        self.bytes_of: list[bytes] = []
        for k in range(self.size):
            piece = model.id_to_piece(k)
            if model.is_unused(k):
                raise ValueError("unused pieces are not supported")
            if model.is_byte(k):
                self.byte[int(piece[3:5], 16)] = k
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_unknown(k):
                self.bytes_of.append(model.decode([k]).encode())
            elif model.is_control(k):
                self.bytes_of.append(b"")
            else:
                self.ids[piece], scores[piece] = k, model.get_score(k)
                self.bytes_of.append(piece.replace(MARKER, " ").encode())
        crossing = [p for p in self.ids if MARKER in p.lstrip(MARKER)]
        probe = "ﬁ a  ½ "
        as_is = model.encode(probe, out_type=str) == model.encode(MARKER.join(probe.split(" ")), out_type=str)
        if crossing or not as_is or model.decode(model.encode(probe)) != probe or self.unknown in self.byte:
            raise ValueError("needs pieces that do not cross markers, all bytes, and texts taken as they are")
        # A smaller order merges first; pieces of one score share theirs.
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.order = {p: order[s] for p, s in scores.items()}
        self.known = np.full(0x110000, -1, np.int32)  # pieces of one character, by code point
        for piece, k in self.ids.items():
            if len(piece) == 1:
                self.known[ord(piece)] = k
        pairs = {}
        for piece, k in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = (self.order[piece], k)
        self.pairs = PairTable(pairs)
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def segment(self, chunk: str) -> list[int]:
        """Ids of a chunk with all its markers: the best pair is merged, of equal ones the leftmost."""
        parts = list(chunk)
        n, order = len(parts), self.order
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for k in range(n - 1):
            merged = parts[k] + parts[k + 1]
            if merged in order:
                heap.append((order[merged], k, merged))
        heapq.heapify(heap)
        while heap:
            _, k, merged = heapq.heappop(heap)
            j = after[k]
            if j >= n or not parts[k] or parts[k] + parts[j] != merged:
                continue
            parts[k], parts[j] = merged, ""
            after[k] = j = after[j]
            if j < n:
                before[j] = k
                if (both := merged + parts[j]) in order:
                    heapq.heappush(heap, (order[both], k, both))
            if (b := before[k]) >= 0 and (both := parts[b] + merged) in order:
                heapq.heappush(heap, (order[both], b, both))
        out = []
        for part in parts:
            if part:
                known = self.ids.get(part)
                out.extend([self.byte[x] for x in part.encode()] if known is None else [known])
        return out

    def _side_by_side(self, chunks: list[str], width: int) -> list[bytes]:
        """``segment`` for many short chunks: one merge per chunk and round."""
        n = len(chunks)
        points = np.frombuffer("".join(c.ljust(width, "\0") for c in chunks).encode("utf-32-le"), np.uint32)
        points = points.reshape(n, width)
        columns = np.arange(width)
        there = columns < np.array([len(c) for c in chunks])[:, None]
        # A character without a piece is known by its code point until the end.
        ids = np.where(there, np.where(self.known[points] >= 0, self.known[points], -2 - points.astype(np.int32)), -1)
        order, merged = np.full((n, width), NONE, np.int32), np.zeros((n, width), np.int32)
        found = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel())
        order[:, :-1], merged[:, :-1] = (x.reshape(n, width - 1) for x in found)
        row, out = np.arange(n), [b""] * n
        while len(row):
            best = order.argmin(axis=1)  # the leftmost of the smallest
            every = np.arange(len(row))
            going = order[every, best] < NONE
            if not going.all():
                done = ids[~going]
                used = done != -1
                flat, ends = done[used], np.cumsum(used.sum(axis=1)).tolist()
                raw = flat.astype(np.int32).tobytes()
                ours = row[~going].tolist()
                for k, a, b in zip(ours, [0, *ends[:-1]], ends, strict=True):
                    out[k] = raw[4 * a : 4 * b]
                for k in np.flatnonzero((done < -1).any(axis=1)).tolist():
                    out[ours[k]] = self._with_bytes(done[k][used[k]])
                ids, order, merged, row, best = ids[going], order[going], merged[going], row[going], best[going]
                every = np.arange(len(row))
                if not len(row):
                    break
            into = merged[every, best]
            right = columns[:-1] > best[:, None]
            for x, rest in ((ids, -1), (order, NONE), (merged, 0)):
                x[:, :-1] = np.where(right, x[:, 1:], x[:, :-1])
                x[:, -1] = rest
            ids[every, best] = into
            after = np.minimum(best + 1, width - 1)
            order[every, best], merged[every, best] = self.pairs.find(into, np.where(after > best, ids[every, after], -1))
            inner = np.flatnonzero(best)
            before = best[inner] - 1
            order[inner, before], merged[inner, before] = self.pairs.find(ids[inner, before], into[inner])
            used = int((ids != -1).sum(axis=1).max())
            if 2 <= used < width:
                width, columns = used, columns[:used]
                ids, order, merged = ids[:, :used].copy(), order[:, :used].copy(), merged[:, :used].copy()
        return out

    def _with_bytes(self, line: np.ndarray) -> bytes:
        out = []
        for k in line.tolist():
            out.extend([k] if k >= 0 else [self.byte[x] for x in chr(-2 - k).encode()])
        return np.array(out, np.int32).tobytes()

    def segment_all(self, chunks: list[str]) -> list[bytes]:
        """Ids (as int32) of each of the chunks, markers included."""
        out = [b""] * len(chunks)
        lengths = np.array([len(c) for c in chunks], np.int64)
        order = np.argsort(lengths, kind="stable")
        at, short = 0, int((lengths <= SHORT).sum())
        while at < short:
            width = max(2, int(lengths[order[at]]) * 5 // 4)  # lengths up to a quarter above the shortest
            to = min(int(np.searchsorted(lengths[order[:short]], width, side="right")), at + CELLS // width)
            for k, ids in zip(order[at:to], self._side_by_side([chunks[k] for k in order[at:to]], width), strict=True):
                out[k] = ids
            at = to
        for k in order[short:]:
            out[k] = np.array(self.segment(chunks[k]), np.int32).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, without begin and end."""
        cut = [chunks(t) for t in texts]
        asked = set().union(*cut)
        new = list(asked.difference(self.kept).difference(self.older))
        table = dict(zip(new, self.segment_all([MARKER + c.replace(" ", MARKER) for c in new]), strict=True))
        keep = {c: ids for c, ids in table.items() if len(c) <= KEPT_LENGTH}
        for c in asked.difference(new):
            table[c] = keep[c] = self.kept[c] if c in self.kept else self.older[c]
        out = [np.frombuffer(b"".join(map(table.__getitem__, row)), np.int32) for row in cut]
        self.kept.update(keep)
        if len(self.kept) > KEPT:  # what the next texts do not ask for goes with `older`
            self.older, self.kept = self.kept, {}
        return out

    def joined(self, ids: np.ndarray) -> bytes:
        """Bytes of all pieces, markers as spaces."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.starts[ids] - (ends - lengths), lengths)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text: without the space in front, each byte that is no UTF-8 as U+FFFD."""
        silent = np.flatnonzero(self.lengths[ids] == 0)
        text, seen = [], False
        for part in np.split(ids, silent):  # bytes on both sides of a begin or end make no character
            raw = self.joined(part)
            told = part[self.lengths[part] > 0]
            if len(told) and not seen:
                seen = True
                if raw[:1] == b" " and told[0] not in (self.unknown, *self.byte):
                    raw = raw[1:]
            text.append(raw.decode("utf-8", "cohortweave_byte"))
        return "".join(text)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One per worker process."""
    return Pieces(path)


def encode(documents: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """``key`` and ``ids`` (array of int, begin and end ids included), one row per document.

    A null or empty text has begin and end alone. Repeated rows and null keys stay, an empty table
    gives no rows, other columns are ignored; equal texts have equal ids. Texts of any length are
    taken whole; one without a space is one chunk.
    """

    def work(texts: pa.Array) -> list:
        own = pieces(path)
        found = own.encode(texts.fill_null("").to_pylist())
        return [[np.concatenate([[own.begin], ids, [own.end]]).astype(np.int32) for ids in found]]

    return map_texts(documents, [key], text, "ids array<int>", work)


def round_trip(documents: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """``key``, n_tokens (begin and end included), SHA-256 of the ids as unsigned 32-bit integers and
    of the text decoded from them. Rows as in ``encode``, in one pass, so that ids do not leave the task.
    """

    def work(texts: pa.Array) -> list:
        own = pieces(path)
        n, of_ids, of_text = [], [], []
        for ids in own.encode(texts.fill_null("").to_pylist()):
            ids = np.concatenate([[own.begin], ids, [own.end]]).astype("<u4")
            n.append(len(ids))
            of_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
            of_text.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
        return [n, of_ids, of_text]

    return map_texts(documents, [key], text, "n_tokens long, ids_sha256 string, decoded_sha256 string", work)


__all__ = ["Pieces", "chunks", "encode", "pieces", "round_trip"]
