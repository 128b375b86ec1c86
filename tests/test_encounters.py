"""Temporal features against brute force over all pairs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cohortweave.operators import encounters as E

SCHEMA = "encounter string, subject string, start timestamp_ntz, end timestamp_ntz, type string"


def minus_months(moment, months):
    total = moment.year * 12 + moment.month - 1 - months
    year, month = divmod(total, 12)
    following = dt.date(year + (month == 11), (month + 1) % 12 + 1, 1)
    last = (following - dt.timedelta(days=1)).day
    return moment.replace(year=year, month=month + 1, day=min(moment.day, last))


def make(seed, subjects, n, span_days, hours):
    """Encounters crowded around the ends of months; subject s0 has a third of them."""
    random_ = random.Random(seed)
    origin = dt.datetime(2019, 12, 20)
    result = []
    for i in range(n):
        subject = "s0" if random_.random() < 1 / 3 else f"s{random_.randrange(subjects)}"
        start = origin + dt.timedelta(days=random_.randrange(span_days), hours=random_.choice(hours))
        if random_.random() < 0.4:
            start = start.replace(day=random_.choice([1, 28, 29])) if start.month != 2 else start.replace(day=28)
        length = random_.choice([0, 0, 1, 2, 5, 30, 31, 70])
        end = start + dt.timedelta(days=length, hours=random_.choice([0, 0, 3]))
        result.append((f"e{i}", subject, start, end, random_.choice(["planned", "unplanned", None])))
    return result


CASES = [make(1, 5, 120, 90, [0]), make(2, 5, 150, 200, [0, 1, 12, 23]), make(3, 2, 100, 40, [0, 6])]


def values(df):
    return {r["encounter"]: r["value"] for r in df.collect()}


def by_subject(data):
    return [(c, [p for p in data if p[1] == c[1]]) for c in data]


@pytest.mark.parametrize("data", CASES)
@pytest.mark.parametrize("days", [1, 7, 30])
def test_readmission(spark, data, days):
    df = spark.createDataFrame(data, SCHEMA)
    window = dt.timedelta(days=days)
    expected2 = {
        c[0]: float(c[4] == "unplanned" and any(c[2] - window < p[3] < c[2] for p in group))
        for c, group in by_subject(data)
    }
    expected1 = {
        c[0]: float(any(p[4] == "unplanned" and c[3] < p[2] < c[3] + window for p in group))
        for c, group in by_subject(data)
    }
    assert values(E.readmission(df, days)) == expected2
    assert values(E.readmission(df, days, kind=1)) == expected1


@pytest.mark.parametrize("data", CASES)
@pytest.mark.parametrize("months", [1, 2, 12])
def test_hospitalization(spark, data, months):
    df = spark.createDataFrame(data, SCHEMA)
    expected = {
        c[0]: float(sum(p[2] != p[3] and p[3] <= c[2] and p[2] >= minus_months(c[2], months) for p in group))
        for c, group in by_subject(data)
    }
    assert any(expected.values())
    assert values(E.hospitalization_count(df, months)) == expected
    assert values(E.hospitalization_count(df, months, bucket_days=10)) == expected


def test_only_encounters_within_are_compared(spark):
    data = CASES[1]
    df = spark.createDataFrame(data, SCHEMA)
    planned = [p for p in data if p[4] == "planned"]
    expected = {c[0]: 0.0 for c in data}
    expected.update(
        {
            c[0]: float(sum(p[2] != p[3] and p[3] <= c[2] and p[2] >= minus_months(c[2], 2) for p in group))
            for c, group in by_subject(planned)
        }
    )
    within = F.coalesce(F.col("type") == "planned", F.lit(False))
    assert values(E.hospitalization_count(df, 2, within)) == expected
    unplanned = [p for p in data if p[4] == "unplanned"]
    window = dt.timedelta(days=30)
    expected = {c[0]: 0.0 for c in data}
    expected.update(
        {c[0]: float(any(c[2] - window < p[3] < c[2] for p in group)) for c, group in by_subject(unplanned)}
    )
    within = F.coalesce(F.col("type") == "unplanned", F.lit(False))
    assert values(E.readmission(df, 30, within=within)) == expected


def test_mortality(spark):
    data = CASES[1]
    encounters = spark.createDataFrame(data, SCHEMA)
    observed = [
        ("s0", dt.datetime(2021, 9, 1)), ("s1", dt.datetime(2020, 3, 31)), ("s1", dt.datetime(2030, 1, 1)),
        ("s2", dt.datetime(2020, 8, 31, 5)), ("s9", dt.datetime(2020, 1, 1)), ("s3", None), (None, dt.datetime(2020, 1, 1)),
    ]
    observations = spark.createDataFrame(observed, "subject string, date timestamp_ntz")
    expected = {}
    for subject, date in observed:
        if subject and date:
            hit = any(e[1] == subject and e[2] > minus_months(date, 6) for e in data)
            expected[subject] = max(expected.get(subject, 0.0), float(hit))
    flags = E.mortality_flag(observations, encounters, 6)
    assert {r["subject"]: r["value"] for r in flags.collect()} == expected


@pytest.mark.parametrize("hot_rows", [1, 30, 10**9])
def test_only_timelines_of_hot_subjects_and_of_none_are_split(spark, monkeypatch, hot_rows):
    data = [(e, None if s == "s1" else s, *rest) for e, s, *rest in CASES[1]]
    df = spark.createDataFrame(data, SCHEMA)
    expected = {
        c[0]: float(sum(p[2] != p[3] and p[3] <= c[2] and p[2] >= minus_months(c[2], 2) for p in group))
        for c, group in by_subject(data)
    }
    lines = []

    def timeline(*asked, made=E._timeline):
        lines.append(made(*asked))
        return lines[-1]

    monkeypatch.setattr(E, "_timeline", timeline)
    monkeypatch.setattr("cohortweave.operators.skew.HOT_ROWS", hot_rows)
    assert values(E.hospitalization_counts(df, {"value": (2, None)}, source=df)) == expected
    whole, split = [{r["subject"] for r in line.select("subject").collect()} for line in lines]
    n = {s: len([c for c in data if c[1] == s]) for s in whole}
    assert split == {s for s in whole if s is None or n[s] >= hot_rows} and None in whole
