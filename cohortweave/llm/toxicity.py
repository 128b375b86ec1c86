"""Toxicity by compression distance: which of two zstandard dictionaries suits a window better.

Texts are cut into windows, which are compressed with a dictionary trained on toxic and with one
trained on ordinary text. Both are laid in front of the same background, ordinary text too, so
that ordinary wording costs the same with either and only wording of one class makes a
difference. A text's statistic is the sum of the two largest savings of a window; thresholds on it
are calibrated on labelled texts that took no part in training.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.llm.words import LOWER, SPACE, buffers, map_texts

#: Labelled rows of each class used for fitting, at most, and bytes of their texts.
SAMPLE_ROWS, SAMPLE_BYTES = 2_000, 16 << 20
#: Bytes of a window, at most, and what two windows share. So few literals are never entropy-coded,
#: hence a byte more or less in a match is a byte more or less in the result.
WINDOW, OVERLAP = 60, 16
#: Bytes of each class's own dictionary and of the common background.
OWN_BYTES, BACKGROUND_BYTES = 4 << 10, 24 << 10
#: Byte n-grams that tell the classes' wording apart, hashed to so many bits.
GRAM, GRAM_BITS = 5, 20
#: Wording tells if it is in this share of a class's texts, and so many times as usual there.
USUAL, TELLING = 0.01, 50
#: Largest value of the statistic that has its own probability.
LARGEST = 40
#: What an ordinary text weighs against a toxic one in the calibration.
ORDINARY_WEIGHT = 3


def normalized(data: np.ndarray) -> np.ndarray:
    """ASCII lower case; all white space is a space."""
    return np.where(SPACE[data], np.uint8(32), LOWER[data])


def cut(text: bytes) -> list[bytes]:
    """Windows that cover the whole text; a word longer than a window is cut."""
    out, at, n = [], 0, len(text)
    while at < n:
        to = min(n, at + WINDOW)
        if to < n and (space := text.rfind(b" ", at + WINDOW // 2, to)) > 0:
            to = space
        out.append(text[at:to])
        if to == n:
            break
        back = text.find(b" ", to - OVERLAP, to)
        at = back if back > at else to
    return out


@dataclass(frozen=True)
class ToxicityModel:
    """Dictionaries and the probability by saving (0 .. LARGEST bytes)."""

    toxic: bytes
    ordinary: bytes
    probability: tuple[float, ...]

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        return compressor(self.toxic), compressor(self.ordinary)

    def score(self, saving: int) -> float:
        return self.probability[min(max(saving, 0), LARGEST)]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(
        1, min_match=5, strategy=zstandard.STRATEGY_GREEDY, hash_log=15, chain_log=15, window_log=16,
        search_log=4, write_checksum=0, write_content_size=0, write_dict_id=0,
    )
    if not content:
        return zstandard.ZstdCompressor(compression_params=parameters)
    own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    own.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=own, compression_params=parameters)


def saving(text: bytes, pair: tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]) -> int:
    """Bytes by which the toxic dictionary shortens windows more than the other: the two best ones."""
    toxic, ordinary = pair[0].compress, pair[1].compress
    best = second = 0
    for window in cut(text):
        saved = len(ordinary(window)) - len(toxic(window))
        if saved > second:
            best, second = max(best, saved), min(best, saved)
    return best + second


def trained(samples: Sequence[bytes], size: int) -> bytes:
    """Content of a dictionary trained on ``samples``; the samples themselves if they are too few."""
    if sum(map(len, samples)) > 4 * size and len(samples) > 8:
        try:
            raw = zstandard.train_dictionary(size + 1024, list(samples), k=32, d=6).as_bytes()
        except zstandard.ZstdError:
            raw = b""
        # The content follows three 32-bit offsets, which training sets to 1, 4 and 8.
        at = raw.rfind(np.array([1, 4, 8], "<u4").tobytes())
        if at >= 0:
            return raw[at + 12 :][-size:]
    return b" ".join(dict.fromkeys(samples))[-size:]


def _grams(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    h = np.zeros(max(0, len(raw) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x100000001B3) + raw[k : k + len(h)]
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


def telling(texts: Sequence[bytes], others: Sequence[bytes]) -> list[bytes]:
    """Words or their telling parts, as often as ``texts`` hold them.

    An n-gram tells if many of ``texts`` hold it and few ``others`` do. A part of a word counts
    only if it is itself usual, so that single texts and their copies do not tell.
    """
    here, there = np.zeros(1 << GRAM_BITS), np.zeros(1 << GRAM_BITS)
    for counted, rows in ((here, texts), (there, others)):
        for t in rows:
            counted[np.unique(_grams(b" " + t + b" "))] += 1
    ratio = (here / max(1, len(texts))) / ((there + 0.5) / max(1, len(others)))
    least = max(4, USUAL * len(texts))
    marked = (here >= least) & (ratio >= TELLING)
    part: dict[bytes, bytes] = {}
    out = []
    for t in texts:
        for word in t.split():
            if word not in part:
                padded = b" " + word + b" "
                at = np.flatnonzero(marked[_grams(padded)])
                part[word] = padded[at[0] : at[-1] + GRAM] if len(at) else b""
            if part[word]:
                out.append(part[word])
    held = Counter(out)
    return [w for w in out if held[w] >= least]


def monotone(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rising fit to ``values`` (pool adjacent violators)."""
    pools: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            total = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools])


def fit(texts: Sequence[bytes], labels: Sequence[int]) -> ToxicityModel:
    """A model of normalized texts; two thirds train the dictionaries, the rest sets the thresholds.

    Without texts of both classes nothing is toxic.
    """
    toxic = [t for t, y in zip(texts, labels, strict=True) if y]
    ordinary = [t for t, y in zip(texts, labels, strict=True) if not y]
    if len(toxic) < 2 or len(ordinary) < 2:
        return ToxicityModel(b"", b"", (0.0,) * (LARGEST + 1))
    learn = lambda rows: [t for k, t in enumerate(rows) if k % 3]
    check = lambda rows: [t for k, t in enumerate(rows) if not k % 3]
    windows = [w for t in learn(ordinary) for w in cut(t)]
    background = trained(windows[:: 1 + len(windows) // 40_000], BACKGROUND_BYTES)
    own = [trained(telling(learn(a), learn(b)), OWN_BYTES) for a, b in ((toxic, ordinary), (ordinary, toxic))]
    content = [o + b" " + background for o in own]
    pair = (compressor(content[0]), compressor(content[1]))
    counts = np.zeros((2, LARGEST + 1))
    for y, rows in ((1, check(toxic)), (0, check(ordinary))):
        for t in rows:
            counts[y, min(max(saving(t, pair), 0), LARGEST)] += 1
    rate = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1) + 1e-5
    weight = rate[1] + ORDINARY_WEIGHT * rate[0]
    fitted = monotone(rate[1] / weight, weight)
    return ToxicityModel(content[0], content[1], tuple(float(min(max(v, 0.0), 1.0)) for v in fitted))


def sample(
    documents: DataFrame, labels: DataFrame, key: str, text: str, label: str, learn: Column
) -> tuple[list[bytes], list[int]]:
    """At most SAMPLE_ROWS labelled texts of each class, by a hash of the key, and their labels.

    A key labelled more than once counts with its largest label; rows with nulls teach nothing.
    ``learn`` says which keys may be learnt from.
    """
    known = labels.where(learn & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("__y"))
    taken = None
    for y in (1, 0):
        part = known.where(F.col("__y") == y).orderBy(F.xxhash64(key), key).limit(SAMPLE_ROWS)
        taken = part if taken is None else taken.unionByName(part)
    chosen = [(r[0], r[1]) for r in taken.collect()]  # bounded by SAMPLE_ROWS
    if not chosen:
        return [], []
    spark = documents.sparkSession
    wanted = F.broadcast(spark.createDataFrame(chosen, f"`{key}` long, __y int"))
    # Texts up to a length that all of them together may have; longer ones teach nothing.
    most = max(4096, SAMPLE_BYTES // len(chosen) * 4)
    rows = (
        documents.select(F.col(key), F.col(text).alias("__text"))
        .where(F.octet_length("__text") <= most)
        .join(wanted, key)
        .collect()
    )
    rows = sorted({(r[0], r["__text"], r["__y"]) for r in rows})
    out, size = [], 0
    for _, t, y in sorted(rows, key=lambda r: (r[0] * 0x9E3779B97F4A7C15) % (1 << 64)):
        size += len(t)
        if size > SAMPLE_BYTES:
            break
        out.append((normalized(np.frombuffer(t.encode(), np.uint8)).tobytes(), y))
    return [t for t, _ in out], [y for _, y in out]


def score(documents: DataFrame, keep: list[str], text: str, model: ToxicityModel, at_least: float = 0.7) -> DataFrame:
    """``keep``, score (0 to 1) and predicted (1 from ``at_least`` on), one row per document.

    A null or empty text has no window and the score of no saving. Repeated rows stay.
    """
    pairs: list = []

    def work(texts: pa.Array) -> list:
        if not pairs:
            pairs.append(model.compressors())
        data, offsets = buffers(texts)
        raw = normalized(data).tobytes()
        scores = [
            model.score(saving(raw[a:b], pairs[0])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)
        ]
        return [scores, [int(s >= at_least) for s in scores]]

    return map_texts(documents, keep, text, "score double, predicted int", work)
