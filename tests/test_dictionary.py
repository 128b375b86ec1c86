import pytest
from pyspark.sql import functions as F

from cohortweave.operators import dictionary as D
from cohortweave.operators import encode

ROWS = [("a", "x", "2"), ("b", "y", None), ("c", "x", "10"), ("d", None, "2"), ("e", "z", ""), ("f", None, None)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "pid string, s string, `n.1` string")


def found(entries):
    return {(r["column"], r["value"]): (r["count"], r["index"], r["size"]) for r in entries.collect()}


def test_numbers(rows):
    assert found(D.dictionary(rows, ["s", "n.1"])) == {
        ("s", "x"): (2, 0, 3), ("s", "y"): (1, 1, 3), ("s", "z"): (1, 2, 3),
        ("n.1", ""): (1, 0, 3), ("n.1", "10"): (1, 1, 3), ("n.1", "2"): (2, 2, 3),
    }
    frequent = found(D.dictionary(rows, ["n.1"], "frequency"))
    assert {k[1]: v[1] for k, v in frequent.items()} == {"2": 0, "": 1, "10": 2}
    with pytest.raises(ValueError):
        D.dictionary(rows, ["s"], "chance")
    with pytest.raises(ValueError):
        D.dictionary(rows, [])


@pytest.mark.parametrize("small", [100_000, 0])
def test_rows(rows, monkeypatch, small):
    monkeypatch.setattr(D, "SMALL_ENTRIES", small)
    entries = D.dictionary(rows, ["s", "n.1"])
    sparse = {r["pid"]: (r["size"], r["positions"]) for r in D.sparse_rows(rows, "pid", ["n.1", "s"], entries).collect()}
    assert sparse == {
        "a": (6, [2, 3]), "b": (6, [4]), "c": (6, [1, 3]), "d": (6, [2]), "e": (6, [0, 5]), "f": (6, [])
    }
    kept = D.sparse_rows(rows, "pid", ["s", "n.1"], entries, "skip")
    assert sorted(r["pid"] for r in kept.collect()) == ["a", "c", "e"]
    with pytest.raises(Exception, match="lacks"):
        D.sparse_rows(rows, "pid", ["s"], entries, "error").collect()
    with pytest.raises(ValueError):
        D.sparse_rows(rows, "pid", ["s"], entries, "drop")


def test_a_value_the_dictionary_lacks(spark, rows):
    entries = D.dictionary(rows.where("s = 'x'"), ["s"])
    sparse = D.sparse_rows(rows, "pid", ["s"], entries)
    assert {r["pid"]: r["positions"] for r in sparse.collect()} == {"a": [0], "c": [0], **dict.fromkeys("bdef", [])}


def test_agrees_with_the_wide_form(rows):
    wide = encode.onehot_wide(rows.drop("n.1"), ["s"])
    flags = {r["pid"]: [i for i, c in enumerate(wide.columns[1:]) if r[c]] for r in wide.collect()}
    sparse = D.sparse_rows(rows, "pid", ["s"], D.dictionary(rows, ["s"])).collect()
    assert flags == {r["pid"]: r["positions"] for r in sparse}


def test_sites_send_counts_only(rows):
    tagged = rows.withColumn("site", F.when(F.col("pid") < "c", "one").otherwise("two"))
    counts = D.value_counts(tagged, ["s"], ["site"])
    assert counts.columns == ["site", "column", "value", "count"]
    assert found(D.numbered(D.merged(counts))) == found(D.dictionary(rows, ["s"]))


def test_equal_keys_and_repeated_rows_stay(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), (None, "y"), ("b", None), ("b", None)], "pid string, s string")
    sparse = D.sparse_rows(rows, "pid", ["s"], D.dictionary(rows, ["s"])).collect()
    assert sorted((r["pid"] or "", r["positions"]) for r in sparse) == [
        ("", [1]), ("a", [0]), ("a", [0]), ("a", [1]), ("b", []), ("b", [])
    ]


def test_empty(spark):
    none = spark.createDataFrame([], "pid string, s string")
    entries = D.dictionary(none, ["s"])
    assert entries.collect() == [] and D.sparse_rows(none, "pid", ["s"], entries).collect() == []
    one = spark.createDataFrame([("a", None)], "pid string, s string")
    assert [tuple(r) for r in D.sparse_rows(one, "pid", ["s"], entries).collect()] == [("a", 0, [])]


def test_a_million_values(spark):
    """Far more values than columns could be; half of the rows hold one value."""
    n = 1_000_000
    many = spark.range(0, 2 * n, 1, 8).select(
        F.col("id").cast("string").alias("pid"), F.when(F.col("id") < n, F.format_string("%07d", "id")).otherwise("0000005").alias("s")
    )
    entries = D.dictionary(many, ["s"])
    assert entries.where("size <> 1000000 or index <> cast(value as long)").count() == 0 and entries.count() == n
    assert entries.groupBy(F.spark_partition_id()).count().count() > 1
    sparse = D.sparse_rows(many, "pid", ["s"], entries)
    wrong = F.col("positions")[0] != F.when(F.col("pid").cast("long") < n, F.col("pid").cast("long")).otherwise(5)
    assert sparse.agg(F.count("*"), F.count_if(wrong)).first()[:] == (2 * n, 0)


def test_large_dictionaries_are_joined_column_by_column(rows, monkeypatch):
    """A row is not taken apart into its values, each with the whole row beside it, and gathered again."""
    entries = D.dictionary(rows, ["s", "n.1"])
    small = sorted(tuple(r) for r in D.sparse_rows(rows, "pid", ["s", "n.1"], entries).collect())
    monkeypatch.setattr(D, "SMALL_ENTRIES", 0)
    large = D.sparse_rows(rows, "pid", ["s", "n.1"], entries)
    assert sorted(tuple(r) for r in large.collect()) == small
    assert "collect_set" not in large._jdf.queryExecution().optimizedPlan().toString()
