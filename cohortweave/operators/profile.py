"""Statistics of a prepared dataset: one pass for the numbers, one for the values.

Results are long: one row per variable. ``by`` adds grouping columns, for example
the site. Value counts combine before the shuffle; the ranking keeps only the first
``top_k + 1`` values per task and variable before anything is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cohortweave.functions.expressions import ratio
from cohortweave.session import materialize

# Number of values listed by themselves, and the name of the rest.
TOP_K = 4
OTHERS = "Others"


def _profiled(df: DataFrame, columns: Sequence[str] | None, by: Sequence[str]) -> list[T.StructField]:
    fields = [f for f in df.schema if f.name != "pid" and f.name not in by]
    if columns is not None:
        fields = [f for f in fields if f.name in columns]
    return [f for f in fields if isinstance(f.dataType, T.StringType | T.DoubleType)]


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def summary(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Per variable: records, nulls, null_percentage; for numbers min, max, mean.

    One aggregation over all variables. The null percentage of an empty table is null.
    """
    fields = _profiled(df, columns, by)
    aggregates = [F.count(F.lit(1)).alias("records")]
    for i, f in enumerate(fields):
        c = _col(f.name)
        aggregates.append(F.count(c).alias(f"present_{i}"))
        if isinstance(f.dataType, T.DoubleType):
            aggregates += [F.min(c).alias(f"min_{i}"), F.max(c).alias(f"max_{i}"), F.avg(c).alias(f"mean_{i}")]
    grouped = df.groupBy(*by).agg(*aggregates)

    def number(name: str, i: int, f: T.StructField) -> Column:
        known = isinstance(f.dataType, T.DoubleType)
        return (F.col(f"{name}_{i}") if known else F.lit(None).cast("double")).alias(name)

    per_variable = [
        F.struct(
            F.lit(f.name).alias("variable"),
            F.lit("numeric" if isinstance(f.dataType, T.DoubleType) else "categorical").alias("data_type"),
            (F.col("records") - F.col(f"present_{i}")).alias("nulls"),
            number("min", i, f),
            number("max", i, f),
            number("mean", i, f),
        )
        for i, f in enumerate(fields)
    ]
    long = grouped.select(*by, "records", F.explode(F.array(*per_variable)).alias("s"))
    return long.select(*by, "records", "s.*").withColumn(
        "null_percentage", ratio(F.col("nulls"), F.col("records")) * 100
    )


def value_counts(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``(variable, value, count)`` of every distinct value, null included.

    Numbers are grouped as numbers and turned into text afterwards.
    """
    per_variable = [
        F.struct(
            F.lit(f.name).alias("variable"),
            (_col(f.name) if isinstance(f.dataType, T.StringType) else F.lit(None).cast("string")).alias("text"),
            (_col(f.name) if isinstance(f.dataType, T.DoubleType) else F.lit(None).cast("double")).alias("number"),
        )
        for f in _profiled(df, columns, by)
    ]
    long = df.select(*by, F.explode(F.array(*per_variable)).alias("s")).select(*by, "s.*")
    counts = long.groupBy(*by, "variable", "text", "number").agg(F.count(F.lit(1)).alias("count"))
    value = F.coalesce(F.col("text"), F.col("number").cast("string"))
    return counts.select(*by, "variable", value.alias("value"), "count")


def distribution(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """:func:`value_counts` with the percentage of all records."""
    keys = [*by, "variable"]
    # One row per variable and group, written so that its size is known; a shuffle by
    # variable would gather its values.
    records = materialize(summary(df, columns, by).select(*keys, "records"))
    joined = value_counts(df, columns, by).join(records, keys)
    return joined.select(
        *by, "variable", "value", "count", (ratio(F.col("count"), F.col("records")) * 100).alias("percentage")
    )


def top_values(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: Sequence[str] = (),
    top_k: int = TOP_K,
    numbers: DataFrame | None = None,
) -> DataFrame:
    """The ``top_k`` most frequent values per variable, and ``Others`` if there are more.

    Ties go by value. Also carries ``rank``, 1 for the most frequent. ``numbers`` may
    hold the :func:`summary` that has been computed already.
    """
    keys = [*by, "variable"]
    order = Window.partitionBy(*keys).orderBy(F.col("count").desc(), F.col("value").asc_nulls_last())
    ranked = value_counts(df, columns, by).withColumn("rank", F.row_number().over(order))
    first = ranked.filter(F.col("rank") <= top_k + 1)
    numbers = (summary(df, columns, by) if numbers is None else numbers).select(*keys, "records")
    # From here on there are at most top_k + 1 rows per variable.
    listed = F.array_sort(F.collect_list(F.struct("rank", "value", "count")))
    lists = first.groupBy(*keys).agg(listed.alias("listed")).join(numbers, keys)
    share = F.transform(
        F.filter("listed", lambda r: r["rank"] <= top_k),
        lambda r: F.struct(
            r["rank"].alias("rank"),
            r["value"].alias("value"),
            r["count"].alias("count"),
            (r["count"].cast("double") / F.col("records") * 100).alias("percentage"),
        ),
    )
    lists = lists.withColumn("top", share)
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    others = F.struct(
        F.lit(top_k + 1).alias("rank"),
        F.lit(OTHERS).alias("value"),
        (F.col("records") - F.aggregate("top", zero, lambda a, r: a + r["count"])).alias("count"),
        (100 - F.aggregate("top", none, lambda a, r: a + r["percentage"])).alias("percentage"),
    )
    rows = F.when(F.size("listed") > top_k, F.concat("top", F.array(others))).otherwise(F.col("top"))
    return lists.select(*keys, F.inline(rows))


def profile(
    df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (), top_k: int = TOP_K
) -> DataFrame:
    """All statistics of every variable, with ``value_distribution`` as an array."""
    keys = [*by, "variable"]
    entry = F.struct("rank", "value", "count", "percentage")
    numbers = materialize(summary(df, columns, by))
    distributions = (
        top_values(df, columns, by, top_k, numbers)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(entry)).alias("ranked"))
        .select(
            *keys,
            F.transform(
                "ranked",
                lambda r: F.struct(r["value"].alias("value"), r["count"].alias("count"), r["percentage"].alias("percentage")),
            ).alias("value_distribution"),
        )
    )
    return numbers.join(distributions, keys, "left")
