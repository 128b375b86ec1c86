"""Time-based features of encounters, without pairing a subject's encounters.

Input is ``encounters(encounter, subject, start, end, type)``. A subject may own a
large share of all encounters, so no operator here compares every encounter with
every other one of its subject, nor sorts a whole hot subject in one task:

* readmission needs only the earliest and the latest moment per subject and time
  bucket, which combine before the shuffle;
* the number of earlier stays is a running count of interval ends, for hot subjects
  split into day buckets whose starting values are summed beforehand;
* mortality compares two extremes per patient.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortweave.functions.expressions import day_bucket, days_after, days_before, months_before
from cohortweave.operators.skew import dealt, hot_keys, repeated

# Fixed value: type of an encounter that counts as a readmission.
UNPLANNED = "unplanned"


def _flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def readmission(
    encounters: DataFrame,
    days: int,
    kind: int = 2,
    within: Column | None = None,
    name: str = "value",
    source: DataFrame | None = None,
) -> DataFrame:
    """``encounters`` with column ``name``, 1.0 or 0.0; both bounds are strict.

    Kind 2: an unplanned encounter, and an encounter of the subject ended within
    ``days`` before its start. Kind 1: an unplanned encounter of the subject starts
    within ``days`` after the end of this one.

    Buckets are ``days`` wide. Within one bucket two moments are always closer
    than ``days``, so only the order matters; in the neighbouring bucket only the
    distance does. One extreme each decides. The rows that ask about a bucket are
    joined in up to 63 parts of a crowded subject, so a crowded bucket is not one task.

    With ``within``, only encounters for which it is true are compared; the others
    get 0.0. ``source`` may name the same encounters where they are cheaper to read
    again, without columns that were added since.
    """
    if kind == 1:
        moment, probe, shift = F.col("start"), F.col("end"), -1
        same, other = F.max("same"), F.min("other")
        hit = (F.col("same") > probe) | (F.col("other") < days_after(probe, days))
    else:
        moment, probe, shift = F.col("end"), F.col("start"), 1
        same, other = F.min("same"), F.max("other")
        hit = (F.col("type") == UNPLANNED) & (
            (F.col("same") < probe) | (F.col("other") > days_before(probe, days))
        )
    if within is not None:
        hit = hit & within
    none = F.lit(None).cast(encounters.schema["start"].dataType)
    participates = F.lit(True) if within is None else within
    if kind == 1:
        participates = participates & (F.col("type") == UNPLANNED)

    def entry(bucket: Column, same: Column, other: Column, asks: bool = False) -> Column:
        return F.struct(bucket.alias("bucket"), same.alias("same"), other.alias("other"), F.lit(asks).alias("asks"))

    at = day_bucket(moment, days)
    entries = F.array(
        entry(day_bucket(probe, days), none, none, True),
        F.when(participates, entry(at, moment, none)),
        F.when(participates, entry(at + shift, none, moment)),
    )
    # One row per bucket that is asked about; of a crowded subject, per part of the rows that ask.
    read = encounters if source is None else source
    hot = hot_keys(read, "subject", "encounter")
    extremes = (
        read
        .select("subject", F.explode(entries).alias("e"))
        .filter("e is not null")
        .select("subject", "e.*")
        .groupBy("subject", "bucket")
        .agg(same.alias("same"), other.alias("other"), F.max("asks").alias("asks"))
        .filter("asks")
        .drop("asks")
    )
    columns = encounters.columns
    return (
        dealt(encounters.withColumn("bucket", day_bucket(probe, days)), hot, "subject", "encounter", "part")
        .join(repeated(extremes, hot, "subject", "part"), ["subject", "bucket", "part"], "left")
        .select(*columns, _flag(F.coalesce(hit, F.lit(False))).alias(name))
    )


def hospitalization_count(
    encounters: DataFrame,
    months: int,
    within: Column | None = None,
    name: str = "value",
    bucket_days: int = 1,
) -> DataFrame:
    """``encounters`` with column ``name``: the subject's earlier stays, as a double.

    A stay is an encounter whose end differs from its start. It counts if it ended
    at or before the start of this encounter and began at or after that start
    minus ``months`` calendar months. ``within`` as in :func:`readmission`.
    """
    return hospitalization_counts(encounters, {name: (months, within)}, bucket_days)


def _timeline(encounters: DataFrame, counted: Sequence[tuple[int, Column]]) -> DataFrame:
    """``(subject, t, c0, c1, ..., row)``: changes of each count, and rows that ask for it.

    Seen from the moments t that ask, a stay counts from its end until the last
    moment whose date minus the months is not after its start. That subtraction
    keeps the time of day and cuts the day to the length of the month. So the last
    day of a short month is reached from several days, each of which is a span of
    its own; and a day that no date leads to is passed at the following midnight.
    """
    kind = encounters.schema["start"].dataType
    day = F.col("start").cast("date")
    row = F.struct(*[c for c in encounters.columns if c not in ("subject", "start")])  # these are beside it
    asks = encounters.select(
        "subject",
        "start",
        "end",
        day.alias("day"),
        (F.col("start") - day.cast(kind)).alias("time"),
        row.alias("row"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("which"),
                        F.add_months(day, months).alias("first"),
                        ((F.col("start") != F.col("end")) & within).alias("counts"),
                    )
                    for i, (months, within) in enumerate(counted)
                ]
            )
        ).alias("v"),
    ).select("*", "v.*")
    cut = F.dayofmonth("first") != F.dayofmonth("day")
    last = F.when(~cut & (F.col("day") == F.last_day("day")), F.last_day("first")).otherwise(F.col("first"))
    days = asks.withColumn("cut", cut).withColumn("at", F.explode_outer(F.sequence(F.col("first"), last)))
    is_first = F.coalesce(F.col("at") == F.col("first"), F.lit(True))
    tick = F.expr("INTERVAL '0.000001' SECOND")
    midnight = F.col("at").cast(kind)
    opens = F.when(is_first, F.col("end")).otherwise(F.greatest(F.col("end"), midnight))
    closes = F.when(F.col("cut"), F.date_add("at", 1).cast(kind)).otherwise(midnight + F.col("time") + tick)
    spans = days.withColumns({"lo": opens, "hi": closes, "asks": is_first & (F.col("which") == 0)})
    spans = spans.withColumn("counts", F.col("counts") & (F.col("lo") < F.col("hi")))

    def entry(moment: Column, change: int, row: Column) -> Column:
        changes = [
            F.when(F.col("which") == i, F.lit(change)).otherwise(F.lit(0)).cast("long").alias(f"c{i}")
            for i in range(len(counted))
        ]
        return F.struct(moment.alias("t"), *changes, row.alias("row"))

    no_row = F.lit(None).cast(spans.schema["row"].dataType)
    entries = F.array(
        F.when(F.col("asks"), entry(F.col("start"), 0, F.col("row"))),
        F.when(F.col("counts"), entry(F.col("lo"), 1, no_row)),
        F.when(F.col("counts"), entry(F.col("hi"), -1, no_row)),
    )
    return spans.select("subject", F.explode(entries).alias("e")).filter("e is not null").select("subject", "e.*")


def hospitalization_counts(
    encounters: DataFrame,
    counted: Mapping[str, tuple[int, Column | None]],
    bucket_days: int = 1,
    source: DataFrame | None = None,
) -> DataFrame:
    """Several :func:`hospitalization_count` columns, name -> (months, within), in one pass.

    The timeline of a subject is one window; that of a hot one, and of rows without a subject, is
    split into day buckets. ``source`` as in :func:`readmission`.
    """
    kind = encounters.schema["start"].dataType
    columns = encounters.columns
    compared = [(months, F.lit(True) if w is None else w) for months, w in counted.values()]
    changes = [f"c{i}" for i in range(len(compared))]
    read = encounters if source is None else source
    hot = hot_keys(read, "subject", "encounter")
    split = F.col("_bits").isNotNull() | F.col("subject").isNull()
    bucket = day_bucket(F.col("t"), bucket_days)
    whole = _timeline(encounters, compared).join(hot, "subject", "left")
    timeline = whole.withColumn("bucket", F.when(split, bucket)).drop("_bits")
    totals = _timeline(read.join(hot, "subject", "left").filter(split).drop("_bits"), compared).withColumn("bucket", bucket)

    # Value at the start of every bucket: sums per bucket, then a running sum over
    # a hot subject's buckets, of which there are no more than days in the data. Only
    # buckets in which a row asks need it.
    before = Window.partitionBy("subject").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first_moment = F.date_add(F.lit("1970-01-01").cast("date"), (F.col("bucket") * bucket_days).cast("int"))
    carried = (
        totals.groupBy("subject", "bucket")
        .agg(*[F.sum(c).alias(c) for c in changes], F.bool_or(F.col("row").isNotNull()).alias("asked"))
        .select("subject", "bucket", "asked", *[F.sum(c).over(before).alias(c) for c in changes])
        .filter(F.col("asked") & reduce(lambda a, b: a | b, [F.col(c) != 0 for c in changes]))
    )
    no_row = F.lit(None).cast(timeline.schema["row"].dataType)
    openings = carried.select("subject", first_moment.cast(kind).alias("t"), *changes, no_row.alias("row"), "bucket")
    running = (
        Window.partitionBy("subject", "bucket")
        .orderBy("t")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counts = [F.sum(c).over(running).cast("double").alias(f"_{c}") for c in changes]
    values = [
        F.when(w, F.col(f"_c{i}")).otherwise(F.lit(0.0)).alias(name)
        for i, (name, (_, w)) in enumerate(zip(counted, compared, strict=True))
    ]
    return (
        timeline.unionByName(openings)
        .select("subject", "t", "row", *counts)
        .filter("row is not null")
        .select("subject", F.col("t").alias("start"), "row.*", *[f"_{c}" for c in changes])
        .select(*columns, *values)
    )


def mortality_flag(observations: DataFrame, encounters: DataFrame, months: int) -> DataFrame:
    """``(subject, value)`` for every subject with a dated observation.

    ``observations(subject, date)``, ``encounters(subject, start)``. 1.0 if some
    encounter starts after some observation's date minus ``months``. There is no
    upper bound, so the earliest cut-off and the latest encounter decide.
    """
    cutoffs = (
        observations.filter("subject is not null and date is not null")
        .groupBy("subject")
        .agg(F.min(months_before(F.col("date"), months)).alias("cutoff"))
    )
    latest = encounters.groupBy("subject").agg(F.max("start").alias("latest"))
    joined = cutoffs.join(latest, "subject", "left")
    hit = F.coalesce(F.col("latest") > F.col("cutoff"), F.lit(False))
    return joined.select("subject", _flag(hit).alias("value"))
