import re

import pytest

from cohortweave.llm import license_scan as L
from cohortweave.llm.sql import _expression


def scan(text, templates=L.TEMPLATES):
    return L.Scanner(templates, L.PHRASES).scan(text.encode())


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0", 1.0),
        ("licensed under the apache licence version 2.0", "", 0.0),
        ("Released under the MIT License.", "mit", 1.0),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc", 1.0),
        ("All rights reserved.", "reserved", 0.5),
        ("Copyright (c) 2021 A. Name. All rights reserved.", "copyright-reserved,reserved", 1.0),
        ("the GNU General Public License", "gpl,gpl-notice", 1.0),
        ("a General  Public\nLicense", "gpl", 0.5),
        ("general public", "", 0.0),
        ("", "", 0.0),
    ],
)
def test_notices(text, labels, score):
    assert scan(text)[5:] == (labels, score)


@pytest.mark.parametrize(
    "markup", ["a [[b|c d]] e", "a {{2}} b [[c [[d]] ]]", "a [[b]] [[c]] {{1}} d", "a b [[{{3}} c]]"]
)
def test_automaton_is_the_regular_expression(markup):
    machine, expression = L.compile_template("x", markup), re.compile(_expression(markup))
    words = "a b c d e".split()
    texts = [[]]
    for _ in range(6):
        texts = [t + [w] for t in texts for w in words][:4000] + texts[:50]
        for t in texts:
            found = any(machine.accepts([w.encode() for w in t], k) >= 0 for k in range(len(t)))
            assert found == (expression.search(" ".join(t) + " ") is not None), (markup, t)


@pytest.mark.parametrize("markup", ["[[a]]", "{{2}}", "[[a"])
def test_templates_without_mandatory_wording_are_refused(markup):
    with pytest.raises(ValueError, match="mandatory"):
        L.compile_template("x", markup)


def test_places_and_words():
    found = scan("Ünder CC BY, all_rights reserved; cc by! All-Rights-Reserved 日本")
    assert found[:5] == (12, 4, 1, 8, "cc-by,reserved")


def test_operator(spark, documents, texts, nothing):
    found = {r.doc_id: r for r in L.scan_licenses(documents, "doc_id", "text").collect()}
    for i, t in texts:
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
        assert found[i].n_words == len(words) and found[i].n_base == 0 and found[i].first_word is None
    assert L.scan_licenses(nothing, "doc_id", "text").collect() == []
    rows = [(None, "cc by"), (1, "cc by"), (1, "cc by"), (2, "word " * 50_000 + "cc by")]
    out = L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted((r.doc_id or 0, r.n_base, r.last_word) for r in out) == [(0, 1, 0), (1, 1, 0), (1, 1, 0), (2, 1, 50_000)]
