"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Every rule is a condition on counts of one text. A bounded sample tells what each rule costs and
how many texts it rejects; the rules are then asked in the order of rejections per cost, and a
text's first failing rule ends its questioning: counts that only later rules use are never made for
it. The order never changes a verdict.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Rows of the sample that sets the order of the rules, on average and at most.
SAMPLE_ROWS, SAMPLE_LIMIT = 2_048, 4_096
#: Times that a rule is timed on the sample (the shortest counts), and the least cost in seconds.
TIMED, LEAST_COST = 3, 1e-3
#: Counts that the query's contract returns for every text.
CONTRACT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class QualityRule:
    """``fails`` is SQL over the counts of ``counts`` named in ``uses``."""

    name: str
    fails: str
    uses: tuple[str, ...]
    cost: float = 1.0
    rejected: float = 0.0


#: The base rules come with the contract of the query; the others are this module's own.
BASE_RULES = (
    QualityRule("few_words", "n_words < 50", ("n_words",)),
    QualityRule("repeated_words", "100 * n_repeat_words > 50 * n_words", ("n_words", "n_repeat_words")),
)
RULES = BASE_RULES + (
    QualityRule("symbols", "10 * n_symbols > 3 * n_words", ("n_words", "n_symbols")),
    QualityRule("duplicate_lines", "2 * n_dup_lines > n_lines", ("n_lines", "n_dup_lines")),
    QualityRule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words", ("n_words", "word_chars")),
    QualityRule("shouting", "5 * n_upper > 3 * n_letters", ("n_letters", "n_upper")),
)


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def line_array(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def counts(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Counts of a text, all but that of repeated words; ``text`` is not null."""
    return {
        "n_words": F.size(words),
        "word_chars": F.char_length(F.concat_ws("", words)),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_letters": F.regexp_count(text, F.lit(r"\p{L}")),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
    }


def with_repeats(df: DataFrame, words: str, into: str, size: int = 3) -> DataFrame:
    """Words lying in windows of ``size`` words that the text holds more than once.

    The windows' 64-bit hashes are sorted together with their places; equal neighbours are the
    repeated ones, and each adds the words up to the next repeated place, ``size`` at most.
    """
    n = F.size(F.col(words))
    window = lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(size)])
    hashes = F.when(
        n > size,
        F.transform(F.sequence(F.lit(0), n - size), window),
    )
    df = df.withColumn("__h", hashes)
    # Texts without a repeated window end here: sorting longs is cheap, sorting places is not.
    some = F.size(F.array_distinct(F.col("__h"))) < F.size(F.col("__h"))
    df = df.withColumn(
        "__s",
        F.when(
            some,
            F.sort_array(F.transform(F.col("__h"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    at = F.col("__s")
    same = lambda x, k: F.coalesce(F.get(at, k)["h"] == x["h"], F.lit(False))
    places = F.sort_array(
        F.transform(
            F.filter(at, lambda x, k: same(x, k - 1) | same(x, k + 1)),
            lambda x: x["i"],
        )
    )
    df = df.withColumn("__p", places)
    p = F.col("__p")
    covered = F.aggregate(
        F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return df.withColumn(into, F.coalesce(covered, F.lit(0).cast("long"))).drop("__h", "__s", "__p")


def prepared(documents: DataFrame, text: str, *others: Column) -> DataFrame:
    """``__text`` and its words ``__w`` next to the other columns; a null text is an empty one."""
    df = documents.select(*others, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    return df.withColumn("__w", word_array(F.col("__text")))


def with_counts(df: DataFrame, names: Sequence[str], asked: Column | None = None) -> DataFrame:
    """``df`` of ``prepared`` with the counts it lacks, made only for rows where ``asked`` holds."""
    asked = F.lit(True) if asked is None else asked
    for name in names:
        if name in df.columns:
            continue
        if name == "n_repeat_words":
            df = with_repeats(df.withColumn("__asked", F.when(asked, F.col("__w"))), "__asked", name).drop("__asked")
            continue
        if name in ("n_lines", "n_dup_lines") and "__lines" not in df.columns:
            df = df.withColumn("__lines", F.when(asked, line_array(F.col("__text"))))
        count = counts(F.col("__text"), F.col("__w"), F.col("__lines"))[name]
        df = df.withColumn(name, F.when(asked, count.cast("long")))
    return df


def measured(
    df: DataFrame, text: str, rules: Sequence[QualityRule], always: Sequence[str] = CONTRACT
) -> list[QualityRule]:
    """``rules`` in the order of rejections per second, seen on a random sample.

    A rule's cost is the time that it takes for the whole sample beyond that of a rule without
    counts; what is counted ``always`` is no cost of a rule. A rule that rejects nothing in the
    sample comes last; ties go by name.
    """
    rows = df.count()
    sample = df.sample(min(1.0, SAMPLE_ROWS / max(1, rows)), seed=6).limit(SAMPLE_LIMIT)
    sample = with_counts(prepared(sample, text), always).repartition(1).persist()

    def timed(fails: Column, uses: Sequence[str]) -> tuple[float, int]:
        verdict = with_counts(sample, uses).agg(F.count_if(fails).alias("n"))
        took = []
        for _ in range(TIMED):
            began = time.monotonic()
            rejected = verdict.first()["n"]
            took.append(time.monotonic() - began)
        return min(took), rejected

    try:
        total = sample.count()
        nothing, _ = timed(F.size("__w") < 0, ())
        out = []
        for rule in rules:
            took, rejected = timed(F.expr(rule.fails), rule.uses)
            cost = max(LEAST_COST, took - nothing) if set(rule.uses) - set(always) else LEAST_COST
            out.append(replace(rule, cost=cost, rejected=rejected / max(1, total)))
    finally:
        sample.unpersist()
    return sorted(out, key=lambda r: (-r.rejected / r.cost, r.name))


def quality(
    documents: DataFrame,
    key: str,
    text: str,
    rules: Sequence[QualityRule] = RULES,
    order: bool = True,
    always: Sequence[str] = CONTRACT,
) -> DataFrame:
    """``key``, the counts of ``always``, ``failed_rule`` (null: none), ``rules_asked`` and ``kept``, a row per document.

    Rules are asked one after the other, as long as none fails; ``rules_asked`` says how many were, the
    failed one included. Counts that are not in ``always`` are made when the first rule that uses them is
    asked. With ``order`` the sample sets the order, so that of several failed rules ``failed_rule``
    names the first one asked; ``kept`` does not depend on it. Null and empty texts have no words.
    Repeated rows and null keys stay; other columns are ignored.
    """
    asked = measured(documents, text, rules, always) if order else list(rules)
    df = with_counts(prepared(documents, text, F.col(key).alias("__key")), always)
    df = df.withColumn("__failed", F.lit(None).cast("int"))
    for number, rule in enumerate(asked):
        df = with_counts(df, rule.uses, F.col("__failed").isNull())
        df = df.withColumn("__failed", F.coalesce(F.col("__failed"), F.when(F.expr(rule.fails), F.lit(number))))
    names = F.array(*[F.lit(r.name) for r in asked]).cast("array<string>")
    failed = F.col("__failed")
    return df.select(
        F.col("__key").alias(key),
        *always,
        F.get(names, failed).alias("failed_rule"),
        F.coalesce(failed + 1, F.lit(len(asked))).alias("rules_asked"),
        failed.isNull().alias("kept"),
    )
