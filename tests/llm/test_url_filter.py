import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortweave.llm.sql import RULES, SPAM
from cohortweave.llm.url_filter import GlobAutomaton, Rule, escape, filter_urls


def pattern(glob):
    parts = re.findall(r"\*\*|\*|\?|\\.|.", glob, re.S)
    return "".join(
        ".*" if p == "**" else "[^/]*" if p == "*" else "." if p == "?" else re.escape(p[-1]) for p in parts
    )


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.text("ab/.*?", max_size=12), min_size=1, max_size=25),
    st.lists(st.text("ab/.", max_size=12), max_size=20),
)
def test_automaton_is_the_globs(globs, texts):
    found = GlobAutomaton(globs).match(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert found[k].tolist() == [re.fullmatch(pattern(g), text, re.S) is not None for g in globs]


def test_states_carry_over_words():
    long = "x" * 150
    automaton = GlobAutomaton(["a*b", long, "**" + long + "?"])
    found = automaton.match(pa.array([long, "ab", "zz" + long + "q", long[:-1], None]))
    assert found.tolist() == [
        [False, True, False], [True, False, False], [False, False, True], [False] * 3, [False] * 3,
    ]


def judged(spark, urls):
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rows = rows.selectExpr("*", "'x' as rule", "'y' as host")
    found = filter_urls(rows, "page_id", "url", [Rule(*r) for r in RULES], SPAM).collect()
    return [(r.host, r.path, r.rule, r.verdict) for r in sorted(found, key=lambda r: r.page_id)]


def test_rules(spark):
    assert judged(
        spark,
        [
            "http://A.Example.ORG/es/1?q#f", "https://example.org/en/12", "http://example.org/en/2", "http://x.com/de/1",
            "http://x.com/fr/1", "http://x.com/en/1", "http://org", "http://notorg/", "no url", None, "",
            "http://evil.com/x.org/", "http://cheap-pills.example.net/en", "x://y://z/p", "http:///only/path",
            "http://x.org?/a", "http://m.x.org#/a", "http://" + "a" * 3000 + ".org/",
        ],
    ) == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"),
        ("example.org", "/en/2", "org/", "allow"), ("x.com", "/de/1", "com/de/", "block"),
        ("x.com", "/fr/1", "com/fr/", "allow"), ("x.com", "/en/1", None, "allow"), ("org", "", None, "allow"),
        ("notorg", "/", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("evil.com", "/x.org/", None, "allow"), ("cheap-pills.example.net", "/en", None, "block"),
        ("y:", "//z/p", None, "allow"), ("", "/only/path", None, "allow"), ("x.org", "", None, "allow"),
        ("m.x.org", "", None, "allow"), ("a" * 3000 + ".org", "/", "org/", "allow"),
    ]


def test_ties_and_nothing(spark):
    rows = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c"), (None, None)], "k long, u string")
    rules = [Rule("allow", "a.b", "/"), Rule("block", "a.b", "/")]
    found = filter_urls(rows, "k", "u", rules).collect()
    assert sorted((r.k or 0, r.verdict) for r in found) == [(0, "allow"), (1, "block"), (1, "block")]
    assert filter_urls(rows.limit(0), "k", "u", rules).collect() == []
    assert [r.verdict for r in filter_urls(rows, "k", "u", []).collect()] == ["allow"] * 3
    assert escape("a*b?") == "a\\*b\\?"
