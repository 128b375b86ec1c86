"""Words of whole texts as numpy arrays, and the mapping of texts in bounded slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Texts are worked on in slices of at most so many bytes (a longer text is a slice of its own).
SLICE_BYTES = 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# The first k bytes of a little-endian word of eight.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64 bits (changes ``h``)."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Words:
    """Words of consecutive texts: the hash, the text's number and the place of each."""

    hashes: np.ndarray  # uint64
    text: np.ndarray  # int64, ascending
    starts: np.ndarray  # byte positions in data
    ends: np.ndarray
    data: np.ndarray  # uint8
    n_texts: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.n_texts)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array and the n + 1 offsets into them; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words_of(texts: pa.Array, lower: bool = False) -> Words:
    """Maximal runs of bytes other than space and 0x09-0x0D, hashed to 64 bits.

    Words of up to eight bytes and the same length get distinct hashes.
    """
    data, offsets = buffers(texts)
    if lower:
        data = LOWER[data]
    inside = ~SPACE[data]
    edge = np.empty(len(data) + 1, bool)
    edge[-1:] = False
    if len(data):
        edge[0] = True
        edge[1:-1] = ~inside[:-1]
        edge[offsets[:-1][offsets[:-1] < len(data)]] = True  # a text's first byte begins a word
        starts = np.flatnonzero(inside & edge[:-1])
        last = np.empty(len(data), bool)
        last[-1] = True
        last[:-1] = ~inside[1:] | edge[1:-1] & inside[1:]
        ends = np.flatnonzero(inside & last) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    text = np.searchsorted(offsets[1:], starts, side="right")
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = ends - starts
    hashes = mix(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    hashes = mix(hashes ^ (eight[starts] & _FIRST[np.minimum(left, 8)]))
    active, k = np.flatnonzero(left > 8), 8
    while len(active):
        part = eight[starts[active] + k] & _FIRST[np.minimum(left[active] - k, 8)]
        hashes[active] = mix(hashes[active] ^ part)
        k += 8
        active = active[left[active] > k]
    return Words(hashes, text, starts, ends, data, len(offsets) - 1)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive hashes (across texts too; see ``inside``)."""
    n = max(0, len(hashes) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += hashes[k : k + n]
        h ^= h >> np.uint64(29)
    return mix(h)


def inside(text: np.ndarray, size: int) -> np.ndarray:
    """Which windows of ``size`` words lie in one text."""
    n = max(0, len(text) - size + 1)
    return text[:n] == text[size - 1 : size - 1 + n]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(offset, length) of runs of texts of at most ``most`` bytes, or of one longer text."""
    _, offsets = buffers(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to - at
        at = to


def map_texts(
    df: DataFrame,
    keep: list[str],
    text: str,
    schema: str,
    work: Callable[[pa.Array], list],
    most: int = SLICE_BYTES,
) -> DataFrame:
    """``keep`` and what ``work`` makes of the texts, a slice at a time, row for row.

    ``schema`` names the columns of ``work``'s arrays; other columns of ``df`` are not read.
    """
    made = StructType.fromDDL(schema)
    kept = StructType([df.schema[c] for c in keep])
    whole = StructType(kept.fields + made.fields)
    arrow = to_arrow_schema(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(len(keep)), most):
                part = batch.slice(at, n)
                arrays = [part.column(k).cast(arrow.field(k).type) for k in range(len(keep))]
                for array, field in zip(work(part.column(len(keep))), list(arrow)[len(keep) :], strict=True):
                    arrays.append(pa.array(array, field.type))
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in arrow])

    return df.select(*[F.col(c) for c in keep], F.col(text).cast("string")).mapInArrow(run, whole)


def filter_texts(df: DataFrame, text: str, passes: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text passes."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            for start, n in slices(texts, 1 << 20):
                keep = np.asarray(passes(texts.slice(start, n)), bool)
                yield batch.slice(start, n).filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)
