"""License scans: templates with optional and replaceable regions as automata over words.

Markup: ``[[...]]`` is an optional region, ``{{n}}`` stands for up to n words of any kind, all other
words are mandatory. A text is accepted where the mandatory wording stands exactly, word for
word, wherever in the text it begins.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortweave.llm.words import buffers, map_texts

#: Bytes that end a word; the others are lower-cased and kept.
WORD_BYTES = np.full(256, 0x20, np.uint8)
for _a, _b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    WORD_BYTES[_a:_b] = np.arange(_a, _b, dtype=np.uint8)
WORD_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B, dtype=np.uint8)
_TABLE = WORD_BYTES.tobytes()

#: Label by phrase (fixed values).
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Label and wording of common notices, in the markup above (fixed values).
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license [[,]] version 2.0 [[the license [[you may not use this file "
     "except in compliance with the license]]]]"),
    ("mit", "[[released|licensed|distributed under the terms of]] [[the]] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files {{4}} to deal in {{2}} software without restriction including without "
     "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("cc-by-nc", "licensed under [[the]] cc by nc [[{{1}} 0]]"),
    ("cc-by-sa", "licensed under [[the]] cc by sa [[{{1}} 0]]"),
    ("gpl-notice", "[[under the terms of]] the gnu general public license [[as published by the free software "
     "foundation [[either]] version {{1}} [[of the license]]]]"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
     "provided that the following conditions are met"),
    ("copyright-reserved", "copyright {{8}} all rights reserved"),
)


def words_in(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


@dataclass
class Automaton:
    """States with word edges, empty edges, and edges for any word."""

    label: str
    edges: list[dict[bytes, int]] = field(default_factory=list)
    anything: list[int] = field(default_factory=list)  # target or -1
    empty: list[list[int]] = field(default_factory=list)
    final: int = 0

    def state(self) -> int:
        self.edges.append({})
        self.anything.append(-1)
        self.empty.append([])
        return len(self.edges) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for to in self.empty[todo.pop()]:
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return states

    def accepts(self, words: Sequence[bytes], at: int) -> int:
        """End of the longest accepted wording that begins at word ``at``; -1 if none."""
        states, best = self.closure({0}), -1
        while states:
            if self.final in states:
                best = at
            if at >= len(words):
                break
            word, to = words[at], set()
            for s in states:
                if (k := self.edges[s].get(word)) is not None:
                    to.add(k)
                if self.anything[s] >= 0:
                    to.add(self.anything[s])
            states, at = self.closure(to), at + 1
        return best


def compile_template(label: str, markup: str) -> Automaton:
    """``a|b`` inside a region separates alternatives."""
    machine = Automaton(label)
    at = machine.state()
    regions: list[tuple[int, list[int]]] = []  # entry, ends of finished alternatives
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|\||[^\[\]{}|]+", markup):
        if token == "[[":
            regions.append((at, []))
            inner = machine.state()
            machine.empty[at].append(inner)
            at = inner
        elif token == "|":
            regions[-1][1].append(at)
            at = machine.state()
            machine.empty[regions[-1][0]].append(at)
        elif token == "]]":
            entry, ends = regions.pop()
            out = machine.state()
            for end in [entry, at, *ends]:
                machine.empty[end].append(out)
            at = out
        elif token.startswith("{{"):
            out_of = [at]
            for _ in range(int(token[2:-2])):
                nxt = machine.state()
                machine.anything[at] = nxt
                at = nxt
                out_of.append(at)
            out = machine.state()
            for s in out_of:
                machine.empty[s].append(out)
            at = out
        else:
            for word in words_in(token.encode()):
                nxt = machine.state()
                machine.edges[at][word] = nxt
                at = nxt
    machine.final = at
    if regions or at in machine.closure({0}):
        raise ValueError(f"template {label!r}: an open region or no mandatory wording")
    return machine


class Scanner:
    """Templates by the words they can begin with, and the phrases to look for."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: dict[str, str]):
        self.machines = [compile_template(*t) for t in templates]
        self.by_word: dict[bytes, list[Automaton]] = {}
        for machine in self.machines:
            first = {w for s in machine.closure({0}) for w in machine.edges[s]}
            if any(machine.anything[s] >= 0 for s in machine.closure({0})):
                raise ValueError(f"template {machine.label!r} begins with a replaceable region")
            for word in first:
                self.by_word.setdefault(word, []).append(machine)
        self.phrases = [(words_in(p.encode()), label) for p, label in phrases.items()]
        # A text without any of these bytes has neither a phrase nor a template in it.
        rare = {max(p, key=len) for p, _ in self.phrases}
        for machine in self.machines:
            rare.add(max(self._mandatory(machine), key=len))
        self.needed = sorted(rare)

    @staticmethod
    def _mandatory(machine: Automaton) -> list[bytes]:
        """Words without which the automaton cannot reach its end."""
        out = []
        for word in {w for edges in machine.edges for w in edges}:
            reached, todo = {0}, [0]
            while todo:
                s = todo.pop()
                nexts = [*machine.empty[s], *[t for w, t in machine.edges[s].items() if w != word]]
                if machine.anything[s] >= 0:
                    nexts.append(machine.anything[s])
                for t in nexts:
                    if t not in reached:
                        reached.add(t)
                        todo.append(t)
            if machine.final not in reached:
                out.append(word)
        return sorted(out)

    def scan(self, text: bytes) -> tuple:
        """n_words, n_base, first, last, base labels, all labels, score."""
        spaced = text.translate(_TABLE)
        words = spaced.split()
        if not any(w in spaced for w in self.needed):
            return len(words), 0, None, None, "", "", 0.0
        places, base, labels = [], set(), set()
        accepted = False
        index: dict[bytes, list[int]] = {}
        wanted = set(self.by_word) | {p[0] for p, _ in self.phrases}
        for k, word in enumerate(words):
            if word in wanted:
                index.setdefault(word, []).append(k)
        for phrase, label in self.phrases:
            for k in index.get(phrase[0], ()):
                if words[k : k + len(phrase)] == phrase:
                    places.append(k)
                    base.add(label)
        for word, machines in self.by_word.items():
            for k in index.get(word, ()):
                for machine in machines:
                    if machine.accepts(words, k) >= 0:
                        labels.add(machine.label)
                        accepted = True
        score = 1.0 if accepted else 0.5 if base else 0.0
        return (
            len(words),
            len(places),
            min(places, default=None),
            max(places, default=None),
            ",".join(sorted(base)),
            ",".join(sorted(base | labels)),
            score,
        )


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
)


def scan_licenses(
    documents: DataFrame,
    key: str,
    text: str,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
) -> DataFrame:
    """``key`` and what the scan found in the whole text, one row per document.

    Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased. ``score`` is 1
    where a template's mandatory wording stands exactly, 0.5 where only a phrase does, else 0.
    Null and empty texts have no words; first and last place are null without a phrase, labels
    then empty. Repeated rows and null keys stay; other columns are ignored.
    """
    scanner = Scanner(templates, phrases)

    def work(texts: pa.Array) -> list:
        data, offsets = buffers(texts)
        raw = data.tobytes()
        rows = [scanner.scan(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in range(7)]

    return map_texts(documents, [key], text, SCHEMA, work)
