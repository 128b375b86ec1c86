"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

n-grams of lower-cased letters and single spaces are hashed to a fixed number of features.
Weights are learnt one text at a time by follow-the-regularised-leader with L1 and L2 penalties;
the temperature of the softmax is calibrated on texts that took no part in learning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.llm.words import map_texts

ORDERS = (1, 2, 3)
FEATURE_BITS = 18
#: Rows learnt from, at most, and characters of their texts.
LEARN_ROWS, LEARN_CHARS = 4_000, 12 << 20
#: Follow-the-regularised-leader: step, its offset, penalties, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.1, 3
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single spaces of all texts, and n + 1 offsets; other characters are spaces."""
    lower = [" " + t.lower() + " " for t in texts]
    lengths = np.array([len(t) for t in lower], np.int64)
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(letters()[points], points, np.uint32(32))
    space = points == 32
    keep = np.ones(len(points), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    ends = np.cumsum(lengths)
    if len(ends):
        keep[(ends - lengths)[1:]] = True  # every text begins with its own space
    before = np.concatenate([[0], np.cumsum(keep)])
    return points[keep], before[np.concatenate([[0], ends])]


def features(points: np.ndarray, order: int) -> np.ndarray:
    """Feature of every n-gram of ``order`` code points."""
    n = max(0, len(points) - order + 1)
    h = np.full(n, order, np.uint64)
    for k in range(order):
        h *= np.uint64(0x100000001B3)
        h += points[k : k + n]
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def term_frequencies(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of one text, their share of its n-grams, and the number of n-grams."""
    points, _ = code_points([text])
    every = np.concatenate([features(points, k) for k in ORDERS])
    found, counts = np.unique(every, return_counts=True)
    return found, counts / max(1, len(every)), np.int64(len(every))


@dataclass(frozen=True)
class LanguageModel:
    """``weights`` (features x languages) already hold the inverse document frequencies."""

    languages: tuple[str, ...]
    weights: np.ndarray  # float32
    bias: np.ndarray
    temperature: float

    def logits(self, texts: Sequence[str]) -> np.ndarray:
        """Whole texts; every n-gram counts."""
        points, offsets = code_points(texts)
        total = np.zeros((len(texts), len(self.languages)))
        grams = np.zeros(len(texts))
        for order in ORDERS:
            at = features(points, order)
            first = offsets[:-1]
            # A text's last order - 1 places would begin n-grams that reach into the next text.
            n = np.maximum(0, np.diff(offsets) - order + 1)
            grams += n
            rows = np.vstack([self.weights[at], np.zeros((order, len(self.languages)), np.float32)])
            spans = np.stack([first, first + n], axis=1).ravel()
            sums = np.add.reduceat(rows, spans, axis=0, dtype=np.float64)[::2]
            total += np.where((n > 0)[:, None], sums, 0.0)
        return total / np.maximum(grams, 1)[:, None] + self.bias

    def predict(self, texts: Sequence[str]) -> tuple[list[str], list[float]]:
        """Language and its probability; UNKNOWN and 0 for a text without letters."""
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(axis=1)
        known = [any(map(str.isalpha, t)) for t in texts]
        return (
            [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)],
            [float(p[i, k]) if known[i] else 0.0 for i, k in enumerate(best)],
        )


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(texts: Sequence[str], langs: Sequence[str]) -> LanguageModel:
    """A model of the given texts; every fifth one only sets the temperature."""
    languages = tuple(sorted(set(langs)))
    size, k = 1 << FEATURE_BITS, len(languages)
    if not k:
        return LanguageModel((), np.zeros((size, 0), np.float32), np.zeros(0), 1.0)
    rows = [term_frequencies(t) for t in texts]
    y = np.array([languages.index(x) for x in langs])
    held = np.arange(len(rows)) % 5 == 4
    if k > len(set(y[~held])):  # too few rows to hold some back
        held[:] = False
    documents = np.zeros(size)
    for found, _, _ in rows:
        documents[found] += 1
    idf = np.log((1 + len(rows)) / (1 + documents)) + 1
    # Shares are small numbers; this factor gives the steps of the learner a usual size.
    scale = 30.0
    z, n, zb, nb = np.zeros((size, k)), np.zeros((size, k)), np.zeros(k), np.zeros(k)

    def solved(z, n, l1):
        w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) > l1, w, 0.0)

    order = np.random.default_rng(7)
    learn = np.flatnonzero(~held)
    for _ in range(EPOCHS):
        for r in order.permutation(learn):
            found, share, _ = rows[r]
            x = share * idf[found] * scale
            w, b = solved(z[found], n[found], L1), solved(zb, nb, 0.0)
            error = softmax(x @ w + b)
            error[y[r]] -= 1
            g = x[:, None] * error
            root = np.sqrt(n[found])
            n[found] += g * g
            z[found] += g - (np.sqrt(n[found]) - root) / ALPHA * w
            root = np.sqrt(nb)
            nb += error * error
            zb += error - (np.sqrt(nb) - root) / ALPHA * b
    weights = (solved(z, n, L1) * (idf * scale)[:, None]).astype(np.float32)
    model = LanguageModel(languages, weights, solved(zb, nb, 0.0), 1.0)
    if not held.any():
        return model
    at = np.flatnonzero(held)
    logits = np.concatenate([model.logits([texts[i] for i in at[j : j + 64]]) for j in range(0, len(at), 64)])
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(at)), y[at]] + 1e-12).mean()
    temperature = min(np.geomspace(0.05, 20, 61), key=loss)
    return LanguageModel(languages, weights, model.bias, float(temperature))


def sample(documents: DataFrame, key: str, text: str, lang: str, learn: Column) -> tuple[list[str], list[str]]:
    """At most LEARN_ROWS texts with a language, by a hash of the key; nulls teach nothing.

    Rows without a key are left out, as there is nothing to draw them by.
    """
    rows = (
        documents.where(learn & F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).isNotNull())
        .select(F.col(key), F.col(text).alias("__text"), F.col(lang).cast("string").alias("__lang"))
        .where(F.char_length("__text") <= LEARN_CHARS // 64)
    )
    chosen = rows.select(key, F.xxhash64(key).alias("__h")).orderBy("__h", key).limit(LEARN_ROWS)
    last = chosen.agg(F.max("__h")).first()[0]
    if last is None:
        return [], []
    # The same rows by a comparison: no text goes through the sort. Equal hashes are equal keys.
    found = rows.where(F.xxhash64(key) <= last).limit(2 * LEARN_ROWS).collect()
    found.sort(key=lambda r: ((r[0] * 0x9E3779B97F4A7C15) % (1 << 64), r["__text"], r["__lang"]))
    texts, langs, size = [], [], 0
    for _, t, lang_ in found:
        size += len(t)
        if size > LEARN_CHARS:
            break
        texts.append(t)
        langs.append(lang_)
    return texts, langs


def identify(documents: DataFrame, keep: list[str], text: str, model: LanguageModel) -> DataFrame:
    """``keep``, lang_pred and score, one row per document; repeated rows stay."""

    def work(texts: pa.Array) -> list:
        return list(model.predict(texts.fill_null("").to_pylist()))

    return map_texts(documents, keep, text, "lang_pred string, score double", work, 1 << 20)
