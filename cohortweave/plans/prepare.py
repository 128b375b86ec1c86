"""Data preparation end to end: cohort, variables, wide table, statistics, store."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.operators.features import prepare_features
from cohortweave.operators.profile import profile
from cohortweave.sources.resources import Resources
from cohortweave.sources.store import DatasetStore
from cohortweave.spec import Criterion, Featureset, validate

# Kind of the documents that say why a preparation failed.
FAILURES = "failures"

STATISTICS_SCHEMA = """variable string, data_type string, records bigint, nulls bigint,
    null_percentage double, min double, max double, mean double,
    value_distribution array<struct<value: string, count: bigint, percentage: double>>"""


@dataclass(frozen=True)
class Prepared:
    """A prepared dataset, as stored, and its statistics."""

    dataset: DataFrame
    statistics: DataFrame


def prepare_dataset(
    spark: SparkSession,
    resources: Resources,
    featureset: Featureset,
    criteria: Sequence[Criterion],
    store: DatasetStore,
    dataset_id: str,
    as_of: Column | None = None,
) -> Prepared:
    """Prepare, store and profile a dataset; one that is stored already is returned as it is.

    The statistics read the stored table, so the extraction runs once. A failure is
    stored under a kind of its own, with the error message, and raised; the next
    call prepares the dataset anew. An empty cohort gives an empty dataset with
    zero records.
    """
    validate(featureset, criteria)
    existing = store.dataset(dataset_id)
    if existing is None:
        try:
            store.save_dataset(dataset_id, prepare_features(resources, featureset, criteria, as_of))
        except Exception as error:
            failure = spark.range(1).select(F.lit(str(error)).alias("exception"))
            store.save_document(FAILURES, dataset_id, failure, replace=True)
            raise
        existing = store.dataset(dataset_id)
    statistics = store.document("statistics", dataset_id, STATISTICS_SCHEMA)
    if statistics is None:
        store.save_document("statistics", dataset_id, profile(existing))
        statistics = store.document("statistics", dataset_id, STATISTICS_SCHEMA)
    return Prepared(existing, statistics)
