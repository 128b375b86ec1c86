import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortweave.llm import quality as Q


def counted(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(runs)
    covered = {k + j for k, r in enumerate(runs) if n[r] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
    )


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        "a b c a b c", "a a a a", "a a", "x y z\nx y z\n \nx y z", "### $$ <b> | % & *", "A B C\n", "a\x0bb\x0cc\rd",
        "é ü 😀 ß", " lead and trail ", "a b c d a b c e a b c", "one\n\n\n", None, "", "\n \n", "w " * 3000,
    ]
    return list(enumerate(rows))


def test_counts(spark, documents, texts, odd, nothing):
    for rows, df in ((texts, documents), (odd, spark.createDataFrame(odd, "doc_id long, text string"))):
        found = Q.quality(df, "doc_id", "text").collect()
        assert len(found) == len(rows)
        for r in found:
            got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert got == counted(dict(rows)[r.doc_id]), dict(rows)[r.doc_id]
    assert Q.quality(nothing, "doc_id", "text").collect() == []


def test_order_changes_no_verdict(documents):
    ordered = {r.doc_id: r.kept for r in Q.quality(documents, "doc_id", "text").collect()}
    backwards = Q.quality(documents, "doc_id", "text", Q.RULES[::-1], order=False).collect()
    assert ordered == {r.doc_id: r.kept for r in backwards}
    assert all(r.kept == (r.failed_rule is None) for r in backwards)


def test_rules_that_reject_more_for_less_come_first(documents):
    rules = [
        Q.QualityRule("never", "n_words < 0", ("n_words",)),
        Q.QualityRule("always", "n_words >= 0", ("n_words",)),
        Q.QualityRule("never too", "n_words < -1", ("n_words",)),
    ]
    asked = Q.measured(documents, "text", rules)
    assert [r.name for r in asked] == ["always", "never", "never too"]
    assert asked[0].rejected == 1.0 and all(r.cost > 0 for r in asked)
    assert Q.quality(documents, "doc_id", "text", rules).select("failed_rule").distinct().collect()[0][0] == "always"


def test_a_failed_rule_ends_the_questions(spark, monkeypatch):
    plain = Q.counts
    monkeypatch.setattr(
        Q, "counts", lambda t, w, n: plain(t, w, n) | {"dear": F.when(F.size(w) > 2, 0).otherwise(F.raise_error(F.lit("asked")))}
    )
    rules = [
        Q.QualityRule("short", "n_words < 3", ("n_words",)),
        Q.QualityRule("dear", "dear > 0", ("dear",)),
        Q.QualityRule("many", "n_repeat_words > 2", ("n_repeat_words",)),
    ]
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b c d"), (4, "a b c a b c"), (5, "")], "doc_id long, text string")
    for always in ((), ("n_words",), Q.CONTRACT):
        found = {r.doc_id: r for r in Q.quality(rows, "doc_id", "text", rules, order=False, always=always).collect()}
        assert {k: r.failed_rule for k, r in found.items()} == {1: "short", 2: "short", 3: None, 4: "many", 5: "short"}
        assert {k: r.rules_asked for k, r in found.items()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 1}
        assert all(r.kept == (r.failed_rule is None) for r in found.values())
    with pytest.raises(Exception, match="asked"):
        Q.quality(rows, "doc_id", "text", rules[1:], order=False).collect()


def test_counts_made_only_when_asked_do_not_change_verdicts(documents):
    whole = {r.doc_id: r.kept for r in Q.quality(documents, "doc_id", "text").collect()}
    assert whole == {r.doc_id: r.kept for r in Q.quality(documents, "doc_id", "text", always=()).collect()}


def test_a_key_may_be_named_as_a_count(documents):
    renamed = documents.select(F.col("doc_id").alias("n_letters"), "text", F.lit(1).alias("__w"), F.lit(2).alias("kept"))
    found = {r.n_letters: r.kept for r in Q.quality(renamed, "n_letters", "text").collect()}
    assert found == {r.doc_id: r.kept for r in Q.quality(documents, "doc_id", "text").collect()}


def test_no_python_in_the_plan(documents):
    plan = Q.quality(documents, "doc_id", "text", order=False)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_repeated_rows_and_null_keys_stay(spark):
    rows = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_words) for r in Q.quality(rows, "doc_id", "text").collect()) == [(0, 1), (1, 1), (1, 1)]
