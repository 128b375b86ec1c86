"""Column expressions shared by the operators. All are built-in and code-generated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortweave.spec import INVALID_NAME_CHARACTERS

# Item bands of an age column, [low, high) and name.
AGE_BANDS = (
    (0, 10, "0-10"),
    (10, 20, "10-20"),
    (20, 30, "20-30"),
    (30, 40, "30-40"),
    (40, 50, "40-50"),
    (50, 60, "50-60"),
    (60, 70, "60-70"),
    (70, 80, "70-80"),
    (80, 1000, "80+"),
)

# Share of training rows and seed of the split.
TRAINING_SHARE = 0.8
SPLIT_SEED = 11


def sanitized(column: Column) -> Column:
    """A name column without the characters that a column name may not hold."""
    return F.regexp_replace(F.trim(column), INVALID_NAME_CHARACTERS, "")


def age_in_years(birth: Column, as_of: Column) -> Column:
    """Completed years between two dates."""
    return F.floor(F.months_between(as_of.cast("date"), birth.cast("date")) / 12).cast("double")


def age_band(age: Column) -> Column:
    """Name of the band an age falls into; null for null, negative or absurd ages."""
    low, high, name = AGE_BANDS[0]
    band = F.when((age >= low) & (age < high), F.lit(name))
    for low, high, name in AGE_BANDS[1:]:
        band = band.when((age >= low) & (age < high), F.lit(name))
    return band


def day_bucket(moment: Column, days: int) -> Column:
    """Number of the ``days``-wide bucket a moment falls into, aligned to midnight.

    Two moments in one bucket are less than ``days`` days apart.
    """
    epoch = F.lit("1970-01-01").cast("date")
    return F.floor(F.datediff(moment.cast("date"), epoch) / F.lit(days)).cast("long")


def months_before(moment: Column, months: int) -> Column:
    return moment - F.expr(f"INTERVAL '{int(months)}' MONTH")


def days_before(moment: Column, days: int) -> Column:
    return moment - F.expr(f"INTERVAL '{int(days)}' DAY")


def days_after(moment: Column, days: int) -> Column:
    return moment + F.expr(f"INTERVAL '{int(days)}' DAY")


def in_training_split(pid: Column, seed: int = SPLIT_SEED, share: float = TRAINING_SHARE) -> Column:
    """True for the training rows: a hash of the id, so that no file layout can change it."""
    return hash_percent(pid, seed) < int(round(share * 100))


def hash_percent(pid: Column, seed: int) -> Column:
    """A number in 0..99 drawn from the md5 of the id and the seed."""
    digest = F.md5(F.concat(pid, F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100


def ratio(numerator: Column, denominator: Column, undefined: float | None = None) -> Column:
    """Quotient of two numbers as a double; ``undefined`` where the denominator is 0."""
    denominator = denominator.cast("double")
    quotient = numerator.cast("double") / F.when(denominator != 0, denominator)
    return quotient if undefined is None else F.coalesce(quotient, F.lit(float(undefined)))
