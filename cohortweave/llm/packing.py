"""Best-fit packing of tokenized documents into sequences, by hierarchical residual packing.

Every task packs its own pieces best-fit. Sequences that are nearly full are emitted; the others
go on, whole, as items of the next round, in which a quarter as many tasks pack them again, until
one task with few items is left or a round merges next to nothing. A sequence carries its pieces (at most ``capacity`` of them).
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortweave.llm.words import map_texts
from cohortweave.session import materialize

#: How a byte-level file with use_regex cuts texts (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens of a sequence that may stay empty for it to be emitted before the last round.
SLACK = 8
#: Items that a task packs at once in a later round, and rounds packed in fewer tasks at the same time.
TASK_ITEMS, FAN_IN = 2_000, 4
#: A further round is made while the last one left at most this share of its items underfull.
WORTH = 0.95


def byte_level_ranks(path: str) -> dict[bytes, int] | None:
    """Ranks of a byte-level BPE file, or None where its ids are not the order of its merges."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if spec.get("normalizer") or model["type"] != "BPE" or not plain or model.get("ignore_merges"):
        return None
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"]["".join(m)] for m in pairs]
    if any(a >= b for a, b in zip(ids[:-1], ids[1:], strict=True)):
        return None
    # Printable bytes stand for themselves, the others for code points from 256 on.
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(kept))}
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(of[c] for c in t): k for t, k in model["vocab"].items() if t not in special}


class Tokens:
    """Ids of texts as the tokenizer file gives them, special tokens being ordinary text.

    A byte-level file whose ids are the order of its merges is run by tiktoken, which gives the
    same ids several times faster; any other by the tokenizers library itself.
    """

    def __init__(self, path: str):
        ranks = byte_level_ranks(path)
        if ranks is not None:
            fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.one = fast.encode_ordinary
        else:
            slow = Tokenizer.from_file(path)
            slow.encode_special_tokens = True
            self.one = lambda text: slow.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for text in texts:
            yield np.array(self.one(text), np.uint32)


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    """One per worker process."""
    return Tokens(path)


PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"


def pieces(documents: DataFrame, key: str, text: str, path: str, end: int, capacity: int) -> DataFrame:
    """Rows (``key``, piece, start, length, ids_crc32): each document's ids and ``end``, cut.

    Documents of up to ``capacity`` ids are one piece; of longer ones all pieces but the first have
    ``capacity`` ids. A null or empty text has the id ``end`` alone.
    """

    def work(texts: pa.Array) -> list:
        out = []
        for ids in tokens(path).encode(texts.fill_null("").to_pylist()):
            ids = np.append(ids, np.uint32(end)).astype("<u4")
            cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
            out.append(
                [
                    {"piece": k, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b])}
                    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
                ]
            )
        return [out]

    rows = map_texts(documents, [key], text, f"pieces {PIECES}", work)
    return rows.select(key, F.inline("pieces"))


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Items by falling length, each into the fullest bin that still takes it; ties by number."""
    rooms: list[int] = []  # distinct free rooms, ascending
    by_room: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            bins.append([k])
            number, room = len(bins) - 1, capacity
        else:
            room = rooms[at]
            number = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            bins[number].append(k)
        if left := room - size:
            if left not in by_room:
                by_room[left] = []
                bisect.insort(rooms, left)
            by_room[left].append(number)
    return bins


def _packer(capacity: int, round_: int, last: bool):
    """Packs the items of a task; item = (length, members), a member being a piece's number and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, members = [], []
        for batch in batches:
            lengths.append(batch.column("length").to_numpy())
            members.extend(batch.column("members").to_pylist())
        if not members:
            return
        lengths = np.concatenate(lengths)
        task = TaskContext.get().partitionId()
        rows = []
        for number, own in enumerate(best_fit(lengths, capacity)):
            total = int(lengths[own].sum())
            done = last or capacity - total <= SLACK
            name = (round_ << 56) | (task << 32) | number
            rows.append((name, total, b"".join([members[k] for k in own]), done))
        for at in range(0, len(rows), 10_000):
            part = rows[at : at + 10_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in part], pa.int64()),
                    pa.array([r[1] for r in part], pa.int64()),
                    pa.array([r[2] for r in part], pa.binary()),
                    pa.array([r[3] for r in part], pa.bool_()),
                ],
                names=["sequence_id", "length", "members", "done"],
            )

    return run


PACKED = "sequence_id long, length long, members binary, done boolean"
_MEMBER = np.dtype([("id", "<i8"), ("piece", "<i4"), ("null", "<i4"), ("start", "<i8"), ("length", "<i8"), ("crc", "<i8")])


def _as_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.zeros(batch.num_rows, _MEMBER)
        ids = batch.column(0)
        rows["null"] = ids.is_null().to_numpy(zero_copy_only=False)
        rows["id"] = ids.fill_null(0).to_numpy()
        for k, name in enumerate(("piece", "start", "length", "crc"), 1):
            rows[name] = batch.column(k).to_numpy()
        raw = rows.tobytes()
        size = _MEMBER.itemsize
        yield pa.RecordBatch.from_arrays(
            [batch.column(3), pa.array([raw[k : k + size] for k in range(0, len(raw), size)], pa.binary())],
            names=["length", "members"],
        )


def _unfold(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("members").to_pylist()
            if not blobs:
                continue
            counts = np.array([len(b) // _MEMBER.itemsize for b in blobs])
            rows = np.frombuffer(b"".join(blobs), _MEMBER)
            ends = np.cumsum(rows["length"])
            first = np.cumsum(counts) - counts
            offset = ends - rows["length"]
            offset -= np.repeat(offset[first], counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows["id"], pa.int64(), mask=rows["null"].astype(bool)),
                    pa.array(rows["piece"].copy()),
                    pa.array(rows["start"].copy()),
                    pa.array(rows["length"].copy()),
                    pa.array(rows["crc"].copy()),
                    pa.array(np.repeat(batch.column("sequence_id").to_numpy(), counts)),
                    pa.array(offset),
                ],
                names=[key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(spark: SparkSession, cut: DataFrame, key: str, capacity: int) -> DataFrame:
    """Each row of ``pieces`` with its sequence_id and offset.

    Every round is written before the next one reads it, so a lost executor repeats tasks of one
    round only. ``key`` must be a long; it may be null or repeated.
    """
    schema = f"`{key}` long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    items = cut.select(F.col(key).cast("long"), "piece", "start", "length", "ids_crc32").mapInArrow(
        _as_items, "length long, members binary"
    )
    out, round_, last, before, most = [], 0, False, 0, 0
    while True:
        made = materialize(items.mapInArrow(_packer(capacity, round_, last), PACKED))
        out.append(made.where("done"))
        rest = made.where(~F.col("done"))
        left = 0 if last else rest.count()
        if not left:
            break
        # Tree merge: the rests of at least FAN_IN tasks meet in one task.
        tasks = max(1, left // (TASK_ITEMS * FAN_IN))
        if round_ and (left > WORTH * before or tasks >= most):
            out.append(rest)  # merging further would save next to nothing
            break
        round_, last, before, most = round_ + 1, tasks == 1, left, tasks
        items = rest.select("length", "members").repartition(tasks)
    rounds = out
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out.select("sequence_id", "members").mapInArrow(_unfold(key), schema)


def pack_documents(
    documents: DataFrame,
    key: str,
    text: str,
    path: str,
    end: int = 2,
    capacity: int = 1024,
) -> DataFrame:
    """Every piece of every document with its place: sequence_id and gapless offset.

    No sequence exceeds ``capacity``. An empty table gives no rows; repeated rows are packed each.
    """
    cut = pieces(documents, key, text, path, end, capacity)
    return pack(documents.sparkSession, cut, key, capacity)
