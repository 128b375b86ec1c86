from pyspark.sql import functions as F

from cohortweave.operators import skew


def rows(spark):
    """1000 rows, a third of them under one key."""
    return spark.range(1000).select(
        F.col("id").cast("string").alias("row"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
    )


def test_lookup_is_a_left_join(spark):
    left = rows(spark)
    right = left.groupBy("key").agg(F.count("*").alias("n")).filter("key <> 'k7'")
    plain, spread = left.join(right, "key", "left"), skew.lookup(left, right, "key", "row", left)
    assert spread.columns == plain.columns
    assert spread.count() == 1000
    assert plain.exceptAll(spread).count() == spread.exceptAll(plain).count() == 0
    assert spread.filter("n is null").select("key").distinct().first()["key"] == "k7"
    no_key = left.withColumn("key", F.lit(None).cast("string"))
    assert skew.lookup(no_key, right, "key", "row").filter("n is null").count() == 1000


def test_a_hot_key_is_dealt_out(spark):
    """A third of the rows under one key; no part of a key holds more than a few hundredths of them."""
    left = rows(spark).withColumn("part", skew.part_of(F.col("row")))
    largest = left.groupBy("key", "part").count().agg(F.max("count")).first()[0]
    assert largest <= 0.03 * 1000


def test_parts_of_a_key(spark):
    sets = rows(spark).groupBy("key").agg(
        F.bit_or(skew.part_bit(F.col("row"))).alias("bits"),
        F.array_sort(F.collect_set(skew.part_of(F.col("row")))).alias("expected"),
    )
    assert sets.filter(skew.parts_in(F.col("bits")) != F.col("expected")).count() == 0
    hot = sets.filter("key = 'hot'").first()
    assert len(hot["expected"]) > 55


def test_every_single_part_is_found(spark):
    sets = spark.range(skew.BITS).select(
        F.col("id").cast("int").alias("n"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("id").cast("int")).alias("bits")
    )
    assert sets.filter(skew.parts_in(F.col("bits")) != F.array("n")).count() == 0


def test_only_hot_keys_are_repeated(spark, monkeypatch):
    """What keys with few rows look up is there once, not once for each of their rows."""
    left = rows(spark)
    right = left.groupBy("key").agg(F.count("*").alias("n"))
    parts = lambda: skew.repeated(right, skew.hot_keys(left, "key", "row"), "key").groupBy("key").count()
    assert parts().filter("count > 1").isEmpty()
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    assert [r["key"] for r in parts().filter("count > 1").collect()] == ["hot"]
    plain, spread = left.join(right, "key", "left"), skew.lookup(left, right, "key", "row")
    assert plain.exceptAll(spread).count() == spread.exceptAll(plain).count() == 0
