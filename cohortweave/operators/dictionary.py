"""Dictionaries of categories as tables, and rows encoded by them.

A dictionary has a row per column and value, numbered without gaps, for any number of values: numbers are
prefix counts over ranges of the values, and rows get theirs by a join. No value passes through the driver
and no value becomes a column; where a wide form is wanted, :func:`cohortweave.operators.encode.onehot_wide`
makes one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.operators import skew
from cohortweave.session import materialize

#: A dictionary of at most so many entries and so many bytes of values is sent to all executors.
SMALL_ENTRIES, SMALL_BYTES = 100_000, 8 << 20


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _entries(columns: Sequence[str]) -> Column:
    """A row's values as an array of (column, value); values are compared as strings."""
    return F.array(*[F.struct(F.lit(c).alias("column"), _col(c).cast("string").alias("value")) for c in columns])


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by``, ``column``, ``value``, ``count``: how often each value but null occurs, one scan for all columns."""
    if not columns:
        raise ValueError("no columns to count the values of")
    long = df.select(*[_col(c) for c in by], F.explode(_entries(columns)).alias("_entry")).select(*by, "_entry.*")
    return long.where("value is not null").groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("count"))


def merged(counts: DataFrame) -> DataFrame:
    """Counts of several sites (:func:`value_counts` with ``by``) as those of all; nothing else leaves a site."""
    return counts.groupBy("column", "value").agg(F.sum("count").alias("count"))


def numbered(counts: DataFrame, order: str = "alphabet") -> DataFrame:
    """``column``, ``value``, ``count``, ``index`` and ``size``, the column's number of values.

    Values are numbered from 0 alphabetically, or with ``frequency`` by falling count, ties alphabetically.
    They are dealt out to ranges; a value's number is that within its range and the sizes of the ranges
    before it, of which there are as many as partitions. So no task holds all values of a column.
    """
    if order not in ("alphabet", "frequency"):
        raise ValueError(f"unknown order: {order!r}")
    keys = [F.col("value")] if order == "alphabet" else [F.col("count").desc(), F.col("value")]
    ranges = counts.select("column", "value", "count").repartitionByRange(F.col("column"), *keys)
    ranges = materialize(ranges.withColumn("_range", F.spark_partition_id()))
    whole = Window.partitionBy("column")
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("column", "_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "column", "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("size")
    )
    place = F.row_number().over(Window.partitionBy("column", "_range").orderBy(*keys)) - 1
    found = ranges.withColumn("_place", place).join(offsets, ["column", "_range"])
    return found.select("column", "value", "count", (F.col("_before") + F.col("_place")).alias("index"), "size")


def dictionary(df: DataFrame, columns: Sequence[str], order: str = "alphabet") -> DataFrame:
    """The written dictionary of ``columns``: :func:`numbered` values of all rows."""
    return materialize(numbered(value_counts(df, columns), order))


def sparse_rows(df: DataFrame, key: str, columns: Sequence[str], entries: DataFrame, unknown: str = "keep") -> DataFrame:
    """``key``, ``size`` and ``positions``: where a row's one-hot vector over all ``columns`` holds a 1.

    The columns' values lie one after the other in the order of ``columns``. ``unknown`` says what becomes of
    rows with a null or a value that ``entries`` (of :func:`dictionary`) lacks: ``keep`` gives the value no
    position, ``skip`` leaves the row out, ``error`` fails the job. Rows of equal keys and rows that repeat
    stay as many rows as they are. A column's values are looked up by one join: a small dictionary is sent to
    the rows; for a large one rows of one value are dealt out to parts, as a value may have a large share of
    the rows. Each large column reads ``df`` once more, which should be stored then.
    """
    if unknown not in ("keep", "skip", "error"):
        raise ValueError(f"unknown policy: {unknown!r}")
    extents = entries.groupBy("column").agg(
        F.max("size").alias("size"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("bytes")
    )
    extents = {r["column"]: r for r in extents.collect()}  # a row per column
    start, starts = 0, {}
    for c in columns:
        starts.setdefault(c, start)
        start += extents[c]["size"] if c in extents else 0
    rows = df.select(_col(key).alias("_key"), *[_col(c).cast("string").alias(f"_value{i}") for i, c in enumerate(columns)])
    # Small dictionaries first: what is dealt out for a large one then holds their positions, not their values.
    sizes = {i: (extents[c]["n"], extents[c]["bytes"] or 0) if c in extents else (0, 0) for i, c in enumerate(columns)}
    found, sent, sent_bytes = rows, 0, 0
    for i in sorted(sizes, key=sizes.get):
        right = entries.where(F.col("column") == columns[i]).select(
            F.col("value").alias(f"_value{i}"), (F.col("index") + starts[columns[i]]).cast("long").alias(f"_at{i}")
        )
        if sent + sizes[i][0] <= SMALL_ENTRIES and sent_bytes + sizes[i][1] <= SMALL_BYTES:
            sent, sent_bytes = sent + sizes[i][0], sent_bytes + sizes[i][1]
            found = found.join(F.broadcast(right), f"_value{i}", "left")
        else:
            found = skew.lookup(found, right, f"_value{i}", "_key", rows)
        found = found.drop(f"_value{i}")
    places = [F.col(f"_at{i}") for i in range(len(columns))]
    lost = reduce(lambda a, b: a | b, [p.isNull() for p in places], F.lit(False))
    rows = found.select("_key", lost.alias("_lost"), F.array_sort(F.array_distinct(F.array_compact(F.array(*places)))).alias("positions"))
    if unknown == "skip":
        rows = rows.where("not _lost")
    elif unknown == "error":
        message = F.lit("a row holds a null or a value that the dictionary lacks")
        rows = rows.where(F.when(F.col("_lost"), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
    return rows.select(F.col("_key").alias(key), F.lit(start).cast("long").alias("size"), "positions")
