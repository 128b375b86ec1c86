"""Bookkeeping of a federated run as relations tagged by site.

These tables have one row per site, model or result, so their size is set by the
number of sites and algorithms. They are ordinary joins and groupings all the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# States and selection of sources and models.
EXECUTING = "executing"
READY = "ready"
FINAL = "final"
ERROR = "error"
SELECTED = "selected"
TRAINING = "training"
VALIDATING = "validating"
TESTING = "testing"
MESSAGE_SEPARATOR = "\n"


def dataset_state(sources: DataFrame, dataset: str = "dataset_id") -> DataFrame:
    """State of each dataset from ``(dataset, state, selection)`` of its sources."""
    flags = sources.groupBy(dataset).agg(
        F.bool_or(F.coalesce(F.col("state") == ERROR, F.lit(False))).alias("any_error"),
        F.bool_or(F.coalesce(F.col("selection") == SELECTED, F.lit(False))).alias("any_selected"),
        F.bool_and(F.coalesce(F.col("state") == FINAL, F.lit(False))).alias("all_final"),
    )
    state = (
        F.when(F.col("any_error"), ERROR)
        .when(F.col("any_selected"), FINAL)
        .when(F.col("all_final"), READY)
        .otherwise(EXECUTING)
    )
    return flags.select(dataset, state.alias("state"))


def merge_source_results(sources: DataFrame, results: DataFrame, key: Sequence[str]) -> DataFrame:
    """Sources with the row of a newer result in place of the old one, where there is one.

    ``results`` has the columns of ``sources``. A result replaces the whole row, so
    a null in it is kept.
    """
    columns = [c for c in sources.columns if c not in key]
    newer = results.select(*key, F.struct(*columns).alias("_new"))
    joined = sources.join(newer, list(key), "left")
    return joined.select(
        *key, *[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in columns]
    )


def selected_sites(sources: DataFrame) -> DataFrame:
    """The sources chosen for mining; an error if there are none."""
    chosen = sources.filter(F.col("selection") == SELECTED)
    if chosen.isEmpty():
        raise ValueError("no source of the dataset is selected")
    return chosen


def waiting_sites(selected: DataFrame, received: DataFrame, key: Sequence[str]) -> DataFrame:
    """Selected sites whose result has not arrived. Serves every kind of result."""
    return selected.join(received.select(*key).distinct(), list(key), "left_anti")


def validation_pairs(sites: DataFrame, models: DataFrame, key: Sequence[str] = ("model_id",)) -> DataFrame:
    """``(site, model)``: every model of a run at every other selected site of the run."""
    other = F.col("site") != F.col("model_site")
    return sites.join(models, list(key)).filter(other)


def duplicate_algorithms(algorithms: DataFrame, model: str = "model_id") -> DataFrame:
    """Algorithms named more than once within a model."""
    return algorithms.groupBy(model, "algorithm").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def duplicate_statistics(statistics: DataFrame, model: str = "model_id") -> DataFrame:
    """Statistics received more than once for one site, model site and algorithm."""
    keys = [model, "algorithm", "model_site", "site"]
    return statistics.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def self_validations(statistics: DataFrame) -> DataFrame:
    """Validation results of a model at the site that trained it."""
    return statistics.filter(F.col("site") == F.col("model_site"))


def uneven_ensembles(models: DataFrame, model: str = "model_id") -> DataFrame:
    """Sites missing from an algorithm's ensemble though another algorithm of the run has them."""
    present = models.select(model, "algorithm", "model_site").distinct()
    # Within one run: its algorithms by its sites.
    expected = present.select(model, "algorithm").distinct().join(present.select(model, "model_site").distinct(), model)
    return expected.join(present, [model, "algorithm", "model_site"], "left_anti")


def integrity_violations(algorithms: DataFrame, models: DataFrame, statistics: DataFrame) -> DataFrame:
    """All violations of a run as ``(model_id, check, detail)``; empty when it is sound."""

    def violation(df: DataFrame, check: str, *columns: str) -> DataFrame:
        return df.select("model_id", F.lit(check).alias("check"), F.concat_ws("/", *columns).alias("detail"))

    return (
        violation(duplicate_algorithms(algorithms), "duplicate algorithm", "algorithm")
        .unionByName(violation(uneven_ensembles(models), "site missing from ensemble", "algorithm", "model_site"))
        .unionByName(
            violation(duplicate_statistics(statistics), "duplicate statistics", "algorithm", "model_site", "site")
        )
        .unionByName(violation(self_validations(statistics), "validated at its own site", "algorithm", "model_site"))
    )


def error_rollup(results: DataFrame, model: str = "model_id") -> DataFrame:
    """Models with an error message, and the messages of all sites in order."""
    failed = results.filter(F.col("error_message").isNotNull())
    messages = F.array_sort(F.collect_list("error_message"))
    return failed.groupBy(model).agg(
        F.lit(ERROR).alias("state"), F.concat_ws(MESSAGE_SEPARATOR, messages).alias("error_message")
    )


def model_state(progress: DataFrame) -> DataFrame:
    """State of a prediction model from how many selected sites have delivered.

    ``progress(model_id, selected, trained, validated, tested, errors, chosen)``
    holds counts; ``chosen`` counts ensembles the user selected. A run with one
    site has nobody to validate at and goes from training to testing.
    """
    done = {c: F.col(c) >= F.col("selected") for c in ("trained", "validated", "tested")}
    state = (
        F.when(F.col("errors") > 0, ERROR)
        .when(F.col("chosen") > 0, FINAL)
        .when(~done["trained"], TRAINING)
        .when((F.col("selected") > 1) & ~done["validated"], VALIDATING)
        .when(~done["tested"], TESTING)
        .otherwise(READY)
    )
    return progress.withColumn("state", state)
