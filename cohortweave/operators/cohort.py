"""Who is in the dataset: eligible patients and eligible encounters.

Criteria are semi-joins. All criteria on one resource that only ask for the
existence of a matching resource share one pass: one flag per criterion,
aggregated per subject before the shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.operators.encounters import readmission
from cohortweave.session import lenient, materialize
from cohortweave.sources.resources import Resources, ResourceTable
from cohortweave.spec import Criterion, Readmission, SpecError


def restrict_to_patients(table: ResourceTable, df: DataFrame, patients: DataFrame) -> DataFrame:
    """Rows of ``df`` whose subject (Patient: whose own reference) is a ``pid`` of ``patients``."""
    keyed = df.withColumn("_subject", table.role("subject"))
    allowed = patients.select(F.col("pid").alias("_subject"))
    return keyed.join(allowed, "_subject", "left_semi").drop("_subject")


def encounter_key(table: ResourceTable, existence: bool) -> str:
    """Role by which rows of a table belong to an encounter cohort: subject or encounter."""
    return "subject" if table.name == "Patient" or existence else "encounter"


def restrict_to_encounters(
    table: ResourceTable, df: DataFrame, encounters: DataFrame, existence: bool = False
) -> DataFrame:
    """Rows of ``df`` that belong to the cohort ``encounters(encounter, subject, ...)``.

    Patients and existence checks are matched by subject; encounters by their own
    reference; everything else by the encounter the resource refers to.
    """
    role = encounter_key(table, existence)
    keyed = df.withColumn("_key", table.role(role))
    allowed = encounters.select(F.col(role).alias("_key"))
    return keyed.join(allowed, "_key", "left_semi").drop("_key")


@lenient
def satisfying(df: DataFrame, predicate: str) -> DataFrame:
    """Rows whose predicate is true; null counts as false, and so does a malformed value."""
    return df.filter(F.expr(predicate))


def _matches(table: ResourceTable, criterion: Criterion) -> Column:
    """Predicate of a criterion that looks at single resources."""
    condition = table.condition(criterion.query)
    if criterion.kind != "satisfy":
        return F.lit(True) if condition is None else condition
    predicate = F.expr(criterion.expression)
    return predicate if condition is None else condition & predicate


@lenient
def patients_of_criterion(resources: Resources, criterion: Criterion) -> DataFrame:
    """``pid`` of the subjects of all resources that meet one criterion."""
    table = resources.table(criterion.query)
    found = table.search(criterion.query)
    subject = table.role("subject").alias("pid")
    if criterion.kind == "aggr":
        groups = found.groupBy(subject).agg(F.expr(criterion.expression).alias("_keep"))
        return groups.filter("_keep").select("pid")
    if criterion.kind == "satisfy":
        found = satisfying(found, criterion.expression)
    return found.select(subject).distinct()


def base_patients(resources: Resources, criteria: Sequence[Criterion]) -> DataFrame:
    """Rows of Patient that meet the Patient criterion (all without one), with ``pid``."""
    table = resources["Patient"]
    criterion = next((c for c in criteria if c.resource == "Patient"), None)
    if criterion is None:
        return table.rows.withColumn("pid", table.role("subject"))
    rows = table.search(criterion.query)
    if criterion.kind == "satisfy":
        rows = satisfying(rows, criterion.expression)
    rows = rows.withColumn("pid", table.role("subject"))
    if criterion.kind == "aggr":
        rows = rows.join(patients_of_criterion(resources, criterion), "pid", "left_semi")
    return rows


@lenient
def eligible_patients(resources: Resources, criteria: Sequence[Criterion] = ()) -> DataFrame:
    """Rows of Patient, with ``pid``, that meet every criterion.

    Encounter criteria choose encounters, not patients, and are not looked at here.
    """
    patients = base_patients(resources, criteria)
    by_resource: dict[str, list[Criterion]] = defaultdict(list)
    for criterion in criteria:
        if criterion.resource in ("Patient", "Encounter"):
            continue
        if criterion.kind == "aggr":
            patients = patients.join(patients_of_criterion(resources, criterion), "pid", "left_semi")
        else:
            by_resource[criterion.resource].append(criterion)
    for name, group in by_resource.items():
        table = resources[name]
        flags = [_matches(table, c) for c in group]
        touched = table.rows.filter(reduce(lambda a, b: a | b, flags))
        subjects = touched.groupBy(table.role("subject").alias("pid")).agg(
            *[F.bool_or(F.coalesce(flag, F.lit(False))).alias(f"_c{i}") for i, flag in enumerate(flags)]
        )
        every = reduce(lambda a, b: a & b, [F.col(f"_c{i}") for i in range(len(flags))])
        patients = patients.join(subjects.filter(every).select("pid"), "pid", "left_semi")
    return patients


def encounter_items(table: ResourceTable, df: DataFrame, as_of: Column) -> DataFrame:
    """``(encounter, subject, start, end, type)`` next to the columns of ``df``.

    An open period ends, and an undated one starts, at ``as_of``.
    """
    return (
        df.withColumn("encounter", table.role("ref"))
        .withColumn("_subject", table.role("subject"))
        .withColumn("_type", table.role("type") if table.type else F.lit(None).cast("string"))
        .withColumn("_start", F.coalesce(table.role("start"), as_of))
        .withColumn("_end", F.coalesce(table.role("end"), as_of))
        .drop("subject", "type", "start", "end")
        .withColumnsRenamed({"_subject": "subject", "_type": "type", "_start": "start", "_end": "end"})
    )


ENCOUNTER_COLUMNS = ("encounter", "subject", "start", "end", "type")


@lenient
def encounters_of_criterion(
    resources: Resources, criterion: Criterion, patients: DataFrame, as_of: Column
) -> DataFrame:
    """Encounters of ``patients`` that meet one Encounter criterion."""
    table = resources["Encounter"]
    found = table.search(criterion.query)
    if criterion.kind == "satisfy":
        found = satisfying(found, criterion.expression)
    found = restrict_to_patients(table, found, patients)
    items = encounter_items(table, found, as_of).select(*ENCOUNTER_COLUMNS)
    if criterion.kind == "readmission":
        spec = Readmission.parse(criterion.expression)
        return readmission(items, spec.days, spec.kind).filter("value = 1.0").select(*ENCOUNTER_COLUMNS)
    if criterion.kind not in ("any", "satisfy"):
        raise SpecError(f"an Encounter criterion takes satisfy or a readmission: {criterion.path!r}")
    return items


@lenient
def eligible_encounters(
    resources: Resources,
    criteria: Sequence[Criterion],
    patients: DataFrame,
    as_of: Column,
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Encounters of the eligible patients that meet every Encounter criterion.

    ``extra`` names further columns, computed from the rows of Encounter.
    """
    table = resources["Encounter"]
    # Written, so that both sides of the semi-join come straight out of a shuffle and a patient with
    # very many encounters can be split at run time.
    patients = materialize(patients.select("pid"))
    on_encounters = [c for c in criteria if c.resource == "Encounter"]
    rows = table.rows
    # Criteria about single encounters are conditions on one row: one scan for all of them.
    on_rows = ("any", "satisfy")
    for criterion in on_encounters:
        if criterion.kind in on_rows:
            rows = rows.filter(_matches(table, criterion))
    # The encounter columns may hide columns of the table, so extras come first.
    named = {f"_x{i}": column for i, column in enumerate((extra or {}).values())}
    rows = restrict_to_patients(table, rows.withColumns(named) if named else rows, patients)
    items = encounter_items(table, rows, as_of).select(
        *ENCOUNTER_COLUMNS, *[F.col(f"_x{i}").alias(name) for i, name in enumerate(extra or {})]
    )
    for criterion in on_encounters:
        if criterion.kind not in on_rows:
            keep = encounters_of_criterion(resources, criterion, patients, as_of).select("encounter")
            items = items.join(keep, "encounter", "left_semi")
    return items
