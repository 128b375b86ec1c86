"""Encodings of a prepared dataset: items for rule mining, inputs for learning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortweave.functions.expressions import AGE_BANDS, age_band

AGE = "age"


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def string_columns(df: DataFrame, exclude: Sequence[str] = ("pid",)) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def onehot_wide(
    df: DataFrame, columns: Sequence[str], categories: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Replace each string column by one 0/1 column ``{column}_{value}`` per value.

    ``categories`` may list the values of a column; those of the others are looked up, in one scan
    for all. Values become columns of the plan and so pass through the driver, as a wide form asks
    for; :func:`items_long` gives the same information as rows, for any number of values.
    """
    if not columns:
        return df
    known = {c: list(v) for c, v in (categories or {}).items()}
    found = [(i, v) for i, c in enumerate(columns) for v in known.get(c, ())]
    unknown = [(i, c) for i, c in enumerate(columns) if c not in known]
    if unknown:
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), _col(c).alias("v")) for i, c in unknown])
        values = df.select(F.explode(pairs).alias("p")).select("p.*").filter("v is not null").distinct()
        found += [tuple(row) for row in values.collect()]
    found = sorted(set(found))
    flags = [
        F.when(_col(columns[i]) == v, F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{columns[i]}_{v}")
        for i, v in found
    ]
    kept = [_col(c) for c in df.columns if c not in columns]
    return df.select(*kept, *flags)


def age_bands(df: DataFrame, column: str = AGE) -> DataFrame:
    """Replace an age column by one 0/1 column per band; null or negative ages are 0 in all."""
    band = age_band(_col(column))
    flags = [
        F.when(band == name, F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{column}_{name}")
        for _, _, name in AGE_BANDS
    ]
    return df.select(*[_col(c) for c in df.columns if c != column], *flags)


def categorical_transform(
    df: DataFrame, exclude: Sequence[str] = ("pid",), categories: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """One-hot encode every string column but the excluded ones; band a column named age."""
    encoded = onehot_wide(df, string_columns(df, exclude), categories)
    age = next((c for c in encoded.columns if c.lower() == AGE), None)
    if age is None:
        return encoded
    return age_bands(encoded.withColumnRenamed(age, AGE))


def item_columns(df: DataFrame, exclude: Sequence[str] = ("pid",)) -> list[Column]:
    """Per column the item a row has, or null: what one-hot columns would say, without them.

    A string gives ``{column}_{value}``, an age its band, any other number the
    column's name unless it is 0. Null gives no item.
    """
    items = []
    for f in df.schema:
        if f.name in exclude:
            continue
        c = _col(f.name)
        if isinstance(f.dataType, T.StringType):
            items.append(F.concat(F.lit(f"{f.name}_"), c))
        elif f.name.lower() == AGE:
            items.append(F.concat(F.lit(f"{AGE}_"), age_band(c)))
        else:
            items.append(F.when(c != 0, F.lit(f.name)))
    return items


def items_array(df: DataFrame, keep: Sequence[str] = ("pid",)) -> DataFrame:
    """``keep`` columns and ``items``: the sorted items of every row. No shuffle."""
    items = F.array_sort(F.array_compact(F.array(*item_columns(df, keep))))
    return df.select(*[_col(c) for c in keep], items.alias("items"))


def items_long(df: DataFrame, keep: Sequence[str] = ("pid",)) -> DataFrame:
    """``keep`` columns and ``item``: one row per item of a row. No shuffle."""
    return items_array(df, keep).select(*[_col(c) for c in keep], F.explode("items").alias("item"))


# --- learning ---------------------------------------------------------------


def impute(df: DataFrame, columns: Sequence[str], strategy: str = "median", suffix: str = "_NUM") -> DataFrame:
    """Add ``{column}_NUM`` with nulls replaced by the mean or the approximate median."""
    from pyspark.ml.feature import Imputer

    if not columns:
        return df
    imputer = Imputer(
        inputCols=list(columns), outputCols=[f"{c}{suffix}" for c in columns], strategy=strategy
    )
    return imputer.fit(df).transform(df)


def string_index(df: DataFrame, columns: Sequence[str], handle_invalid: str = "keep") -> DataFrame:
    """Add ``{column}_INDEX``, values numbered alphabetically; one pass for all columns."""
    from pyspark.ml.feature import StringIndexer

    if not columns:
        return df
    indexer = StringIndexer(
        inputCols=list(columns),
        outputCols=[f"{c}_INDEX" for c in columns],
        stringOrderType="alphabetAsc",
        handleInvalid=handle_invalid,
    )
    return indexer.fit(df).transform(df)


def label_index(df: DataFrame, column: str, handle_invalid: str = "error") -> DataFrame:
    """Add ``label``, values numbered by falling frequency, so that 0 is the majority."""
    from pyspark.ml.feature import StringIndexer

    indexer = StringIndexer(
        inputCol=column, outputCol="label", stringOrderType="frequencyDesc", handleInvalid=handle_invalid
    )
    return indexer.fit(df).transform(df)


def minmax_scale(df: DataFrame, columns: Sequence[str], suffix: str = "_SCALED") -> DataFrame:
    """Add ``{column}_SCALED`` in [0, 1]; a constant column becomes 0.5."""
    bounds = df.agg(*[f(_col(c)).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    scaled = {}
    for i, c in enumerate(columns):
        low, high = bounds[f"lo_{i}"], bounds[f"hi_{i}"]
        if low is None or low == high:
            scaled[f"{c}{suffix}"] = F.when(_col(c).isNotNull(), F.lit(0.5))
        else:
            scaled[f"{c}{suffix}"] = (_col(c) - F.lit(low)) / F.lit(high - low)
    return df.withColumns(scaled)


def drop_invalid(df: DataFrame, columns: Sequence[str], handle_invalid: str) -> DataFrame:
    """The row policy for nulls in used columns: ``skip`` drops the rows, ``keep`` keeps them.

    With ``error`` a job that reads such a row fails.
    """
    if handle_invalid not in ("keep", "error", "skip"):
        raise ValueError(f"unknown handle_invalid: {handle_invalid!r}")
    if handle_invalid == "error":
        for c in columns:
            message = F.lit(f"column {c} holds a null and handle_invalid is error")
            df = df.filter(F.when(_col(c).isNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
        return df
    return df.na.drop(subset=list(columns)) if handle_invalid == "skip" else df
