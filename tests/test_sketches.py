import random

import pytest
from pyspark.sql import functions as F

from cohortweave.operators import sketches as K

PROBABILITIES = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


def found(df):
    return {(r["variable"], r["probability"]): r["quantile"] for r in df.collect()}


def test_few_values_are_exact(spark):
    rows = spark.createDataFrame([(1.0, None), (2.0, None), (float("nan"), None), (None, None), (9.0, None)], "a double, b double")
    sketch = K.quantile_sketches(rows, ["a", "b"])
    assert {r["variable"]: r["values"] for r in sketch.collect()} == {"a": 3, "b": 0}
    got = found(K.quantiles(sketch, [0.0, 0.5, 1.0]))
    assert got == {("a", 0.0): 1.0, ("a", 0.5): 2.0, ("a", 1.0): 9.0, **{("b", p): None for p in (0.0, 0.5, 1.0)}}
    with pytest.raises(ValueError):
        K.quantiles(sketch, [1.5])
    with pytest.raises(ValueError):
        K.quantile_sketches(rows, [])


def test_merged_sites_stay_within_the_error(spark):
    """Sites of very different sizes and ranges; a third of all values are equal."""
    rng = random.Random(4)
    values = [("big", 7.0)] * 20_000 + [("big", rng.gauss(0, 5)) for _ in range(30_000)] + [("small", rng.uniform(50, 60)) for _ in range(500)]
    rows = spark.createDataFrame(values, "site string, x double").repartition(7)
    sites = K.quantile_sketches(rows, ["x"], ["site"])
    assert sites.count() == 2
    got = found(K.quantiles(K.merged_sketches(sites), PROBABILITIES))
    ordered, n = sorted(v for _, v in values), len(values)
    for p in PROBABILITIES:
        q = got["x", p]
        below, upto = sum(v < q for v in ordered) / n, sum(v <= q for v in ordered) / n
        assert below - K.RANK_ERROR <= p <= upto + K.RANK_ERROR
    assert got["x", 0.0] == ordered[0] and got["x", 1.0] == ordered[-1] and got["x", 0.9] == 7.0


def test_a_site_without_values(spark):
    rows = spark.createDataFrame([("a", 1.0), ("b", None)], "site string, x double")
    sites = K.quantile_sketches(rows, ["x"], ["site"])
    assert found(K.quantiles(K.merged_sketches(sites), [0.5])) == {("x", 0.5): 1.0}
    assert found(K.quantiles(K.merged_sketches(sites.where("site = 'b'")), [0.5])) == {("x", 0.5): None}
    assert K.quantile_sketches(rows.limit(0), ["x"], ["site"]).collect() == []


def test_impute_from(spark):
    rows = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "x double")
    assert [r["x_NUM"] for r in K.impute_from(rows, {"x": 4}).orderBy(F.col("x_NUM")).collect()] == [1.0, 4.0, 4.0]
