import pytest

from cohortweave.operators import profile as P


@pytest.fixture(scope="module")
def four(spark):
    return spark.createDataFrame(
        [("str1", "str1", 1.0), (None, "str2", 2.0), (None, "str3", 3.0), ("str4", None, 4.0)],
        "strings1 string, strings2 string, numbers double",
    )


def test_golden_statistics(four):
    rows = {r["variable"]: r for r in P.profile(four).collect()}
    assert {r["records"] for r in rows.values()} == {4}
    assert [rows[v]["null_percentage"] for v in ("strings1", "strings2", "numbers")] == [50.0, 25.0, 0.0]
    numbers = rows["numbers"]
    assert (numbers["min"], numbers["max"], numbers["mean"]) == (1.0, 4.0, 2.5)
    assert rows["strings1"]["min"] is None
    listed = {(e["value"], e["count"], e["percentage"]) for e in rows["strings1"]["value_distribution"]}
    assert listed == {("str1", 1, 25.0), ("str4", 1, 25.0), (None, 2, 50.0)}
    assert len(rows["strings2"]["value_distribution"]) == 4
    assert all(e["value"] != "Others" for e in rows["strings2"]["value_distribution"])


def test_others_take_the_rest(spark):
    data = [(v,) for v, n in (("a", 5), ("b", 4), ("c", 3), ("d", 2), ("e", 2), ("f", 1), (None, 3)) for _ in range(n)]
    top = P.top_values(spark.createDataFrame(data, "x string")).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in top] == [("a", 5), ("b", 4), ("c", 3), (None, 3), ("Others", 5)]
    assert sum(r["percentage"] for r in top) == pytest.approx(100)


def test_numbers_with_nulls_keep_their_distribution(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,)], "x double")
    assert {(r["value"], r["count"]) for r in P.distribution(df).collect()} == {("1.0", 2), (None, 1)}


def test_ranking_is_limited_before_the_shuffle(four):
    plan = P.top_values(four)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
