"""URL filters: glob rules as one bit-parallel automaton over canonical URLs.

A glob is matched against ``host + path`` of a URL. ``**`` stands for any characters, ``*`` for
any but ``/``, ``?`` for one character. All globs are packed, state by state, into 64-bit words;
one step of the automaton advances every state of every glob for a whole column of URLs.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.llm.words import buffers, map_texts

UPPER_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows times padded length worked on at once.
CELLS = 1 << 20


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, all its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> tuple[str, str]:
        rest = escape(self.name) + "**"
        return rest, "*." + rest


def escape(literal: str) -> str:
    return re.sub(r"([*?\\])", r"\\\1", literal)


class GlobAutomaton:
    """Shift-And over several words: state k of a glob is set after its first k characters.

    ``step[c]`` holds the states that character c enters, ``stay[c]`` those it may remain in
    because a wildcard follows them.
    """

    def __init__(self, globs: Sequence[str]):
        self.globs = list(globs)
        bits: list[tuple[list[int] | None, str]] = []  # literal that enters the state, loop after it
        self.first, self.final = [], []
        for glob in self.globs:
            self.first.append(len(bits))
            bits.append((None, ""))
            for token in re.findall(rb"\*\*|\*|\?|\\.|.", glob.encode(), re.S):
                if token in (b"*", b"**"):
                    bits[-1] = (bits[-1][0], max(bits[-1][1], token.decode()))
                elif token == b"?":
                    bits.append(([c for c in range(256)], ""))
                else:
                    bits.append(([token[-1]], ""))
            self.final.append(len(bits) - 1)
        self.words = max(1, -(-len(bits) // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        for k in self.first:
            self.start[k // 64] |= np.uint64(1 << (k % 64))
        for k, (enter, loop) in enumerate(bits):
            bit = np.uint64(1 << (k % 64))
            for c in enter or ():
                self.step[c, k // 64] |= bit
            if loop:
                self.stay[:, k // 64] |= bit
                if loop == "*":
                    self.stay[ord("/"), k // 64] &= ~bit

    def match(self, texts: pa.Array) -> np.ndarray:
        """Boolean matrix texts x globs; a null text is an empty one."""
        data, offsets = buffers(texts)
        lengths = np.diff(offsets)
        out = np.zeros((len(lengths), len(self.globs)), bool)
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            # Rows of similar length; the last of a block is its longest.
            to = at + 1
            while to < len(order) and (to + 1 - at) * max(1, lengths[order[to]]) <= CELLS:
                to += 1
            rows, at = order[at:to], to
            out[rows] = self._run(data, offsets[rows], lengths[rows])
        return out

    def _run(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        state = np.tile(self.start, (len(starts), 1))
        one, top = np.uint64(1), np.uint64(63)
        alive = 0  # rows are ordered by length: those before `alive` have ended
        for k in range(int(lengths[-1])):
            alive = int(np.searchsorted(lengths, k, side="right"))
            c = data[starts[alive:] + k]
            now = state[alive:]
            shifted = now << one
            shifted[:, 1:] |= now[:, :-1] >> top
            state[alive:] = (shifted & self.step[c]) | (now & self.stay[c])
        if not self.globs:
            return np.zeros((len(starts), 0), bool)
        final = np.array(self.final)
        return (state[:, final // 64] >> (final % 64).astype(np.uint64) & one).astype(bool)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER_LETTERS, UPPER_LETTERS.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(
    pages: DataFrame,
    key: str,
    url: str,
    rules: Sequence[Rule],
    blocked: Sequence[str] = (),
) -> DataFrame:
    """``key``, host, path, the longest rule that fits, and a verdict.

    Of rules of equal length a block goes first, then the smaller name. Where no rule fits, a
    glob of ``blocked`` that matches ``host + path`` blocks, everything else is allowed. A null
    url or one without ``://`` has empty host and path, which fit no rule. One row per row of
    ``pages``; repeated rows and null keys stay; other columns are ignored.
    """
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "block", r.name))
    automaton = GlobAutomaton([g for r in ordered for g in r.globs()] + list(blocked))
    names = np.array([r.name for r in ordered] + [None], object)
    verdicts = np.array([r.verdict for r in ordered] + ["allow", "block"], object)
    n = len(ordered)

    def work(texts: pa.Array) -> list:
        hits = automaton.match(texts)
        fits = np.zeros((len(hits), n + 1), bool)
        fits[:, :n] = hits[:, : 2 * n : 2] | hits[:, 1 : 2 * n : 2]
        fits[:, n] = True  # no rule
        rule = fits.argmax(axis=1)
        bad = hits[:, 2 * n :].any(axis=1)
        return [
            pa.array(pd.Series(names[rule]), pa.string(), from_pandas=True),
            pa.array(list(verdicts[np.where(rule < n, rule, n + bad)]), pa.string()),
        ]

    parts = pages.select(
        F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    ).withColumn("__url", F.concat("host", "path"))
    return map_texts(parts, [key, "host", "path"], "__url", "rule string, verdict string", work)


__all__ = ["GlobAutomaton", "Rule", "escape", "filter_urls"]
