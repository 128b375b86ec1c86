import pytest
from pyspark.sql import functions as F

from cohortweave.functions.expressions import AGE_BANDS, age_band, in_training_split
from cohortweave.operators import encode


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(
        [("a", "x", 1.0, 5.0), ("b", "y", 0.0, 80.0), ("c", None, None, None), ("d", "x", -2.0, -1.0)],
        "pid string, s string, n double, Age double",
    )


def test_onehot(mixed):
    wide = encode.onehot_wide(mixed, ["s"])
    assert wide.columns == ["pid", "n", "Age", "s_x", "s_y"]
    assert {r["pid"]: (r["s_x"], r["s_y"]) for r in wide.collect()} == {
        "a": (1.0, 0.0), "b": (0.0, 1.0), "c": (0.0, 0.0), "d": (1.0, 0.0)
    }
    listed = encode.onehot_wide(mixed, ["s"], {"s": ["y", "z"]})
    assert listed.columns == ["pid", "n", "Age", "s_y", "s_z"]
    assert {r["pid"]: (r["s_y"], r["s_z"]) for r in listed.collect()}["b"] == (1.0, 0.0)


def test_onehot_has_no_bound_of_values(spark):
    df = spark.range(2500).select(F.col("id").alias("pid"), F.concat(F.lit("v"), F.col("id")).alias("s"))
    assert len(encode.onehot_wide(df, ["s"]).columns) == 2501


def test_bands_are_half_open(spark):
    ages = [0.0, 9.99, 10.0, 79.9, 80.0, 999.0, 1000.0, -0.1, None]
    df = spark.createDataFrame([(a,) for a in ages], "age double").select(age_band(F.col("age")).alias("b"))
    assert [r["b"] for r in df.collect()] == ["0-10", "0-10", "10-20", "70-80", "80+", "80+", None, None, None]


def test_categorical_transform_bands_any_spelling_of_age(mixed):
    wide = encode.categorical_transform(mixed)
    assert wide.columns == ["pid", "n", "s_x", "s_y"] + [f"age_{n}" for _, _, n in AGE_BANDS]


def test_items_agree_with_the_wide_form(mixed):
    wide = encode.categorical_transform(mixed)
    from_wide = {
        r["pid"]: sorted(c for c in wide.columns if c != "pid" and r[c]) for r in wide.collect()
    }
    from_rows = {r["pid"]: r["items"] for r in encode.items_array(mixed).collect()}
    assert from_rows == from_wide == {"a": ["age_0-10", "n", "s_x"], "b": ["age_80+", "s_y"], "c": [], "d": ["n", "s_x"]}
    assert encode.items_long(mixed).count() == 7


def test_nothing_to_encode(mixed):
    assert encode.impute(mixed, []).columns == mixed.columns
    assert encode.string_index(mixed, []).columns == mixed.columns
    assert encode.onehot_wide(mixed, []).columns == mixed.columns


def test_policies(mixed):
    assert encode.drop_invalid(mixed, ["s", "n"], "skip").count() == 3
    assert encode.drop_invalid(mixed, ["s", "n"], "keep").count() == 4
    with pytest.raises(ValueError, match="unknown"):
        encode.drop_invalid(mixed, ["s"], "ignore")
    with pytest.raises(Exception, match="column n holds a null"):
        encode.drop_invalid(mixed, ["n"], "error").count()
    assert encode.drop_invalid(mixed.na.drop(), ["s", "n"], "error").count() == 3


def test_label_zero_is_the_majority(spark):
    df = spark.createDataFrame([("n",), ("y",), ("n",), ("n",), ("y",)], "v string")
    assert {(r["v"], r["label"]) for r in encode.label_index(df, "v").collect()} == {("n", 0.0), ("y", 1.0)}


def test_scaling_a_constant(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0), (None, None)], "a double, b double")
    rows = encode.minmax_scale(df, ["a", "b"]).select("a_SCALED", "b_SCALED").collect()
    assert [tuple(r) for r in rows] == [(0.0, 0.5), (1.0, 0.5), (None, None)]


def test_split_does_not_depend_on_the_layout(spark):
    ids = spark.range(5000).select(F.concat(F.lit("Patient/"), "id").alias("pid"))

    def training(partitions):
        rows = ids.repartition(partitions).filter(in_training_split(F.col("pid")))
        return {r["pid"] for r in rows.collect()}

    first = training(2)
    assert first == training(7)
    assert 0.78 < len(first) / 5000 < 0.82
