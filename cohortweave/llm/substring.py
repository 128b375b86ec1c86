"""Exact repeats across documents, found by fixed blocks and removed.

Documents are dealt out to chunks of bounded size. Every document is cut into non-overlapping
reference blocks of BLOCK words; any repeat of WINDOW words holds a whole block of the document
it stands in (2 * BLOCK - 1 <= WINDOW). Blocks are indexed by hash; every rolling run of BLOCK
words of every document probes the index. A hit that two documents share is an anchor. Around
anchors, and only there, runs of WINDOW words are compared by 64-bit fingerprints over all
documents; consecutive repeated runs make up the maximal repeats.

What a chunk sends is aggregated first: each distinct hash once, sorted, as differences. So a
passage that a third of all documents share costs one entry per chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.llm.tables import bucketed
from cohortweave.llm.words import SLICE_BYTES, Words, inside, map_texts, windows, words_of
from cohortweave.session import materialize

WINDOW, BLOCK = 13, 7
#: Text bytes of a chunk and of what one bucket of hashes stands for, on average.
CHUNK_BYTES, BUCKET_BYTES = SLICE_BYTES, 16 << 20
#: Bits of a hash that are compared within a bucket of block hashes. Too few cost time, never
#: correctness: an anchor only says where to compare fingerprints.
ANCHOR_BITS = 24

PARCEL = "bucket long, chunk long, n long, body binary"


def _buckets(hashes: np.ndarray, n: int) -> np.ndarray:
    """Bucket of every hash: its upper half, scaled."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _parcels(key: np.ndarray, rows: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows of it) for keys sorted by bucket."""
    edges = np.searchsorted(key, np.arange(n + 1))
    for k in np.flatnonzero(np.diff(edges)):
        yield int(k), rows[edges[k] : edges[k + 1]]


def pack(values: np.ndarray) -> bytes:
    """Ascending distinct integers below 2**32 as 16-bit differences; 65535 adds and goes on."""
    gaps = np.diff(values, prepend=0).astype(np.int64)
    more, rest = gaps // 65535, gaps % 65535
    out = np.full(len(gaps) + int(more.sum()), 65535, np.uint16)
    out[np.cumsum(more) + np.arange(len(gaps))] = rest
    return out.tobytes()


def unpack(body: bytes) -> np.ndarray:
    gaps = np.frombuffer(body, np.uint16)
    return np.cumsum(gaps.astype(np.int64))[gaps != 65535]


def _words(table: pa.Table) -> tuple[Words, np.ndarray, np.ndarray, pa.Array]:
    """Words of a chunk by ascending doc_id, the documents' ids, each word's, and the rows' order."""
    ids = table.column("doc_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    text = table.column("text").cast(pa.large_string()).take(pa.array(order)).combine_chunks()
    if isinstance(text, pa.ChunkedArray):
        text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.large_string())
    words = words_of(text)
    ids = ids[order]
    return words, ids, ids[words.text], pa.array(order)


def _block_hashes(words: Words, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every rolling run of BLOCK words, whether it lies in one document, if it is a block."""
    hashes = windows(words.hashes, BLOCK)
    ok = inside(words.text, BLOCK)
    counts = words.counts()
    first = np.cumsum(counts) - counts
    place = np.arange(len(hashes)) - first[words.text[: len(hashes)]]
    return hashes, ok, place % BLOCK == 0


def _post_blocks(buckets: int, bits: int) -> Callable:
    """Each distinct run of a chunk: whether it is a block somewhere, whether two documents have it."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        words, ids, own, _ = _words(table)
        hashes, ok, block = _block_hashes(words, ids)
        short = hashes[ok]
        bucket = _buckets(short, buckets)
        code = (bucket << bits) | (short & np.uint64((1 << bits) - 1)).astype(np.int64)
        order = np.argsort(code, kind="stable")  # by code, then by document
        code, doc, block = code[order], own[: len(hashes)][ok][order], block[ok][order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        if len(first):
            several = np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first)
            anchor = np.logical_or.reduceat(block, first)
        else:
            several = anchor = np.zeros(0, bool)
        code = code[first]
        out = []
        for k, rows in _parcels(code >> bits, np.arange(len(code)), buckets):
            low = code[rows] & ((1 << bits) - 1)
            flags = np.packbits(np.concatenate([several[rows], anchor[rows]])).tobytes()
            out.append((k, len(low), pack(low) + flags))
        return _parcel_table(out, key[0].as_py())

    return run


def _parcel_table(rows: list, chunk: int) -> pa.Table:
    return pa.table(
        {
            "bucket": pa.array([r[0] for r in rows], pa.int64()),
            "chunk": pa.array([chunk] * len(rows), pa.int64()),
            "n": pa.array([r[1] for r in rows], pa.int64()),
            "body": pa.array([r[2] for r in rows], pa.binary()),
        }
    )


def _find_anchors(bits: int) -> Callable:
    """Of each chunk's hashes those that are a block somewhere and stand in two documents."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ns, bodies = table.column("n").to_pylist(), table.column("body").to_pylist()
        docs, anchor = np.zeros(1 << bits, np.uint8), np.zeros(1 << bits, bool)
        lists = []
        for n, body in zip(ns, bodies, strict=True):
            at = len(body) - -(-2 * n // 8)
            low = unpack(body[:at])
            flags = np.unpackbits(np.frombuffer(body[at:], np.uint8))[: 2 * n].astype(bool)
            docs[low] = np.minimum(docs[low] + 1 + flags[:n], 2)
            anchor[low[flags[n:]]] = True
            lists.append(low)
        shared = (docs > 1) & anchor
        found = [low[shared[low]] for low in lists]
        return pa.table(
            {
                "bucket": table.column("bucket"),
                "chunk": table.column("chunk"),
                "n": pa.array([len(x) for x in found], pa.int64()),
                "body": pa.array([pack(x) for x in found], pa.binary()),
            }
        )

    return run


def _candidate_runs(words: Words, ids: np.ndarray, anchors: pa.Table, buckets: int, bits: int) -> np.ndarray:
    """Starts of runs of WINDOW words in one document that hold an anchor."""
    hashes, ok, _ = _block_hashes(words, ids)
    code = (_buckets(hashes, buckets) << bits) | (hashes & np.uint64((1 << bits) - 1)).astype(np.int64)
    lists = [
        (b << bits) | unpack(body)
        for b, body in zip(anchors.column("bucket").to_pylist(), anchors.column("body").to_pylist(), strict=True)
    ]
    known = np.sort(np.concatenate(lists)) if lists else np.zeros(0, np.int64)
    if not len(known) or not len(code):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, code), len(known) - 1)
    hit = ok & (known[at] == code)
    before = np.concatenate([[0], np.cumsum(hit)])
    n = max(0, len(words.hashes) - WINDOW + 1)
    reach = WINDOW - BLOCK + 1
    has = before[reach : reach + n] > before[:n]
    return np.flatnonzero(has & inside(words.text, WINDOW))


def _post_runs(buckets: int, bits: int) -> Callable:
    """Fingerprints of a chunk's candidate runs, each once, with the smallest document that has it."""

    def run(key: tuple, docs: pa.Table, anchors: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _parcel_table([], 0)
        words, ids, own, _ = _words(docs)
        starts = _candidate_runs(words, ids, anchors, buckets, bits)
        prints = windows(words.hashes, WINDOW)[starts]
        doc = own[starts]
        order = np.lexsort((doc, prints))
        prints, doc = prints[order], doc[order]
        first = np.flatnonzero(np.diff(prints.view(np.int64), prepend=~prints[:1].view(np.int64)))
        prints, doc = prints[first], doc[first]
        narrow = not len(doc) or (doc.min() >= 0 and doc.max() < 1 << 32)
        kind = np.uint32 if narrow else np.int64
        out = [
            (k, len(rows), prints[rows].tobytes() + doc[rows].astype(kind).tobytes())
            for k, rows in _parcels(_buckets(prints, buckets), np.arange(len(prints)), buckets)
        ]
        return _parcel_table(out, key[0].as_py())

    return run


def _find_repeats(key: tuple, table: pa.Table) -> pa.Table:
    """Of each chunk's fingerprints those that a smaller document outside the chunk has."""
    ns, bodies = table.column("n").to_pylist(), table.column("body").to_pylist()
    prints, docs = [], []
    for n, body in zip(ns, bodies, strict=True):
        prints.append(np.frombuffer(body[: 8 * n], np.uint64))
        kind = np.uint32 if len(body) == 12 * n else np.int64
        docs.append(np.frombuffer(body[8 * n :], kind).astype(np.int64))
    every, doc = np.concatenate(prints), np.concatenate(docs)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    smallest = np.minimum.reduceat(doc[order], first)
    least = np.empty(len(every), np.int64)
    least[order] = np.repeat(smallest, np.diff(np.append(first, len(every))))
    repeated, found, at = least < doc, [], 0
    for own in prints:
        found.append(own[repeated[at : at + len(own)]])
        at += len(own)
    return pa.table(
        {
            "bucket": table.column("bucket"),
            "chunk": table.column("chunk"),
            "n": pa.array([len(x) for x in found], pa.int64()),
            "body": pa.array([x.tobytes() for x in found], pa.binary()),
        }
    )


def _removed(words: Words, own: np.ndarray, repeats: pa.Table) -> np.ndarray:
    """Which words lie in a run that a smaller document has."""
    prints = windows(words.hashes, WINDOW)
    ok = inside(words.text, WINDOW)
    lists = [np.frombuffer(b, np.uint64) for b in repeats.column("body").to_pylist()]
    known = np.sort(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
    hit = np.zeros(len(prints), bool)
    if len(prints):
        if len(known):
            at = np.minimum(np.searchsorted(known, prints), len(known) - 1)
            hit = known[at] == prints
        # Repeats between documents of the chunk.
        places = np.flatnonzero(ok)
        order = places[np.argsort(prints[places], kind="stable")]  # then by document: words ascend
        ranked = prints[order]
        if len(order):
            new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
            first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            hit[order] |= own[first] < own[order]
        hit &= ok
    covers = np.zeros(len(words.hashes) + WINDOW + 1, np.int64)
    at = np.flatnonzero(hit)
    covers[at] += 1
    covers[at + WINDOW] -= 1
    return np.cumsum(covers)[: len(words.hashes)] > 0


def _joined(words: Words, gone: np.ndarray) -> Iterator[bytes]:
    """Each text's kept words joined by one space."""
    raw, starts, ends = words.data.tobytes(), words.starts.tolist(), words.ends.tolist()
    last = 0
    for end in np.cumsum(words.counts()).tolist():
        yield b" ".join([raw[starts[w] : ends[w]] for w in range(last, end) if not gone[w]])
        last = end


def _cleaned(with_text: bool) -> Callable:
    def run(key: tuple, docs: pa.Table, repeats: pa.Table) -> pa.Table:
        words, ids, own, order = _words(docs)
        gone = _removed(words, own, repeats)
        removed = np.bincount(words.text[gone], minlength=words.n_texts)
        columns = {
            "doc_id": pa.array(ids, pa.int64()),
            "n_words": pa.array(words.counts(), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
        }
        if with_text:
            whole = docs.column("text").take(order).to_pylist()
            columns["kept"] = pa.array(
                [t.decode() if n else w for t, n, w in zip(_joined(words, gone), removed, whole, strict=True)],
                pa.string(),
            )
            columns["rest"] = docs.column("rest").take(order)
        else:
            columns["kept"] = pa.array([hashlib.sha256(t).hexdigest() for t in _joined(words, gone)], pa.string())
        return pa.table(columns)

    return run


def _dealt(documents: DataFrame, key: str, text: str, carry: list[str]) -> tuple[DataFrame, int]:
    """The documents as (chunk, doc_id, text, rest), bucketed by chunk; and the number of buckets of hashes.

    The bucketed table is read three times without being shuffled again.
    """
    spark = documents.sparkSession
    size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    chunks = max(8, size // CHUNK_BYTES)
    rows = documents.select(
        F.pmod(F.xxhash64(key), F.lit(chunks)).alias("chunk"),
        F.col(key).alias("doc_id"),
        F.col(text).alias("text"),
        *([F.struct(*carry).alias("rest")] if carry else []),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return bucketed(rows, "chunk", parts), max(8, int(size // BUCKET_BYTES))


def remove_repeats(
    documents: DataFrame, key: str, text: str, with_text: bool = False, carry: list[str] | None = None
) -> DataFrame:
    """Per row: ``key``, n_words, n_removed, and kept_sha256 of the kept words joined by spaces.

    With ``with_text`` the last column is kept_text instead, the text itself where nothing goes,
    and the columns of ``carry`` follow. A word goes if a run of WINDOW words around it also begins
    in a document with a smaller key. Null and empty texts have no words (kept_text null or empty).
    Rows of one key are one document: they do not repeat each other, and no run reaches from one
    into the next. Rows without a key neither lose words nor make others lose any. ``key`` must be
    a long; other columns are ignored.
    """
    carry = list(carry or []) if with_text else []
    documents = documents.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text), *carry)
    last = "kept_text" if with_text else "kept_sha256"
    docs, buckets = _dealt(documents.where(F.col(key).isNotNull()), key, text, carry)
    posted = docs.groupBy("chunk").applyInArrow(_post_blocks(buckets, ANCHOR_BITS), PARCEL)
    anchors = materialize(posted.groupBy("bucket").applyInArrow(_find_anchors(ANCHOR_BITS), PARCEL).where("n > 0"))
    runs = docs.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(_post_runs(buckets, ANCHOR_BITS), PARCEL)
    repeats = materialize(runs.groupBy("bucket").applyInArrow(_find_repeats, PARCEL).where("n > 0"))
    schema = "doc_id long, n_words long, n_removed long, kept string"
    if carry:
        schema += f", rest {docs.schema['rest'].dataType.simpleString()}"
    made = docs.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(_cleaned(with_text), schema)
    made = made.select(
        F.col("doc_id").alias(key), "n_words", "n_removed", F.col("kept").alias(last), *[f"rest.{c}" for c in carry]
    )

    def untouched(texts: pa.Array) -> list:
        words = words_of(texts)
        kept = [hashlib.sha256(t).hexdigest() for t in _joined(words, np.zeros(len(words.hashes), bool))]
        n = words.counts()
        return [n, np.zeros(len(n), np.int64), texts if with_text else kept]

    without = documents.where(F.col(key).isNull())
    rest = map_texts(without, [key, *carry], text, f"n_words long, n_removed long, {last} string", untouched)
    return made.unionByName(rest)
