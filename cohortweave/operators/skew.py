"""Lookups from rows of which one key may hold a large share.

A run-time split of skewed partitions works only where both sides of a join come
straight out of a shuffle. A side that has been aggregated or joined on the key does
not, so here the rows of every key are dealt out to parts by a hash of the row, and
what they look up is repeated once for each part that the key's rows fall into. A key
with one row has one part; nothing has to be counted beforehand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A set of parts is kept in the bits of one long, without its sign.
BITS = 63
#: A key with so many rows is hot. There are at most as many hot keys as rows by this number.
HOT_ROWS = 10_000


def part_of(row_id: Column) -> Column:
    return F.pmod(F.xxhash64(row_id), F.lit(BITS)).cast("int")


def part_bit(row_id: Column) -> Column:
    """To be combined by ``bit_or`` into the set of parts that a key's rows fall into."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), part_of(row_id))


def parts_in(bits: Column) -> Column:
    """The parts of such a set, as an array."""
    # Most sets hold one part, which needs no search.
    only = F.array(F.round(F.log2(bits)).cast("int"))
    numbers = F.sequence(F.lit(0), F.lit(BITS - 1))
    several = F.filter(numbers, lambda n: F.call_function("getbit", bits, n) == 1)
    return F.when(F.bit_count(bits) == 1, only).otherwise(several)


def hot_keys(rows: DataFrame, key: str, row_id: str) -> DataFrame:
    """``key`` and ``_bits``, the parts its rows fall into, of keys with at least HOT_ROWS rows; sent to all executors."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.bit_or(part_bit(F.col(row_id))).alias("_bits"))
    return F.broadcast(counted.filter(F.col(key).isNotNull() & (F.col("_n") >= HOT_ROWS)).drop("_n"))


def dealt(rows: DataFrame, hot: DataFrame, key: str, row_id: str, part: str = "_part") -> DataFrame:
    """``rows`` with their part: 0, but for rows of a hot key or of none, which are dealt out."""
    own = F.when(F.col("_bits").isNotNull() | F.col(key).isNull(), part_of(F.col(row_id))).otherwise(0)
    return rows.join(hot, key, "left").withColumn(part, own).drop("_bits")


def repeated(looked_up: DataFrame, hot: DataFrame, key: str, part: str = "_part") -> DataFrame:
    """``looked_up`` once for each part that :func:`dealt` gives to the rows of its key."""
    parts = F.when(F.col("_bits").isNull(), F.array(F.lit(0))).otherwise(parts_in(F.col("_bits")))
    return looked_up.join(hot, key, "left").withColumn(part, F.explode(parts)).drop("_bits")


def lookup(left: DataFrame, right: DataFrame, key: str, row_id: str, source: DataFrame | None = None) -> DataFrame:
    """Left join to ``right``, which has one row per key, in up to 63 parts of each hot key.

    ``source`` may name the rows of ``left`` where they are cheaper to read again.
    """
    hot = hot_keys(left if source is None else source, key, row_id)
    return dealt(left, hot, key, row_id).join(repeated(right, hot, key), [key, "_part"], "left").drop("_part")
