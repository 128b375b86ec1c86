"""From resources to one wide row per patient or per encounter.

All variables on one resource with one key are computed in one pass: each is a
conditional aggregate, and the scan keeps the rows any of them wants. Aggregates
combine before the shuffle, so a patient with very many resources costs one row
per task. The wide table is the cohort left-joined to these aggregates on one key,
which keeps its partitioning from join to join.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.operators.cohort import (
    ENCOUNTER_COLUMNS,
    eligible_encounters,
    eligible_patients,
    restrict_to_encounters,
)
from cohortweave.operators.encounters import hospitalization_counts, mortality_flag, readmission
from cohortweave.operators.skew import lookup
from cohortweave.session import lenient, materialize
from cohortweave.sources.resources import Resources, ResourceTable
from cohortweave.spec import Criterion, Featureset, Variable


def _condition(table: ResourceTable, variable: Variable) -> Column:
    condition = table.condition(variable.query)
    return F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))


def _wanted(table: ResourceTable, variables: Sequence[Variable]) -> DataFrame:
    """Rows of the table that at least one variable looks at."""
    if any(table.condition(v.query) is None for v in variables):
        return table.rows
    return table.rows.filter(reduce(lambda a, b: a | b, [table.condition(v.query) for v in variables]))


def _first(table: ResourceTable, value: Column, condition: Column) -> Column:
    """The value of the earliest matching resource; ties and undated ones by reference."""
    order = F.struct(table.role("date"), table.role("ref")) if table.date else table.role("ref")
    return F.min_by(value, F.when(condition, order))


def _typed(variable: Variable, value: Column) -> Column:
    return value.cast("string" if variable.is_categorical else "double")


def _default(variable: Variable) -> Column:
    return F.lit(None).cast("string") if variable.is_categorical else F.lit(0.0)


def _aggregates(table: ResourceTable, variable: Variable) -> list[Column]:
    """The partial results of one variable: ``found`` plus what its kind needs."""
    condition = _condition(table, variable)
    name = variable.column
    columns = [F.max(condition).alias(f"found_{name}")]
    if variable.kind == "value":
        value = _typed(variable, F.expr(variable.expression))
        columns.append(_first(table, value, condition).alias(f"value_{name}"))
    elif variable.kind == "aggr":
        function, argument = variable.aggregate
        value = F.when(condition, F.lit(1) if argument is None else F.expr(argument))
        columns.append(getattr(F, function)(value).cast("double").alias(f"value_{name}"))
    elif variable.kind == "aggr_exists":
        columns.append(F.expr(variable.expression).alias(f"value_{name}"))
    elif table.date:  # exists
        date = table.role("date")
        columns.append(F.min(F.when(condition, date)).alias(f"first_{name}"))
        columns.append(F.max(condition & date.isNull()).alias(f"undated_{name}"))
    return columns


@lenient
def feature_aggregates(
    table: ResourceTable, variables: Sequence[Variable], key: str, rows: DataFrame | None = None
) -> DataFrame:
    """Partial results of several variables, one row per value of the role ``key``."""
    source = _wanted(table, variables) if rows is None else rows
    columns = [c for v in variables for c in _aggregates(table, v)]
    return source.groupBy(table.role(key).alias(key)).agg(*columns)


def _result(variable: Variable) -> Column:
    """Three cases: nothing found (default), found but empty (null), the value."""
    found = F.coalesce(F.col(f"found_{variable.column}"), F.lit(False))
    if variable.kind == "exists":
        return F.when(found, F.lit(1.0)).otherwise(F.lit(0.0))
    value = F.col(f"value_{variable.column}")
    if variable.kind == "aggr_exists":
        return F.when(found & value, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(found, value).otherwise(_default(variable))


def _result_by_end(variable: Variable) -> Column:
    """Existence as of the end of an encounter: a resource dated by then, or undated."""
    name = variable.column
    by_end = (F.col(f"first_{name}") <= F.col("end")) | F.col(f"undated_{name}")
    return F.when(F.coalesce(by_end, F.lit(False)), F.lit(1.0)).otherwise(F.lit(0.0))


def _own_value(table: ResourceTable, variable: Variable) -> Column:
    """Value of a variable on the very resource that makes the row: nothing to join."""
    condition = _condition(table, variable)
    if variable.kind == "exists":
        return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))
    value = _typed(variable, F.expr(variable.expression))
    return F.when(condition, value).otherwise(_default(variable))


def _groups(resources: Resources, variables: Sequence[Variable], key_of) -> dict:
    """Variables that can share one pass, by (resource, key, own pass)."""
    groups: dict[tuple[str, str, str], list[Variable]] = defaultdict(list)
    for v in variables:
        # A free aggregate predicate sees only its own resources.
        own_pass = v.query if v.kind == "aggr_exists" else ""
        groups[(v.resource, key_of(v), own_pass)].append(v)
    return groups


def _mortality(resources: Resources, variable: Variable) -> DataFrame:
    table, encounters = resources["Observation"], resources["Encounter"]
    observations = table.search(variable.query).select(
        table.role("subject").alias("subject"), table.role("date").alias("date")
    )
    starts = encounters.rows.select(
        encounters.role("subject").alias("subject"), encounters.role("start").alias("start")
    )
    flags = mortality_flag(observations, starts, variable.months)
    return flags.select("subject", F.col("value").alias(f"value_{variable.column}"))


def _subject_features(resources: Resources, rows: DataFrame, variables: Sequence[Variable]) -> DataFrame:
    """``rows`` (with ``pid``) left-joined to everything that is keyed by patient."""
    joined = rows
    grouped = [v for v in variables if v.kind != "mortality"]
    for (name, key, _), group in _groups(resources, grouped, lambda v: "subject").items():
        parts = feature_aggregates(resources[name], group, key).withColumnRenamed(key, "pid")
        joined = joined.join(parts, "pid", "left")
    for v in variables:
        if v.kind == "mortality":
            joined = joined.join(_mortality(resources, v).withColumnRenamed("subject", "pid"), "pid", "left")
    return joined


def _subject_result(variable: Variable) -> Column:
    if variable.kind == "mortality":
        return F.coalesce(F.col(f"value_{variable.column}"), F.lit(0.0))
    return _result(variable)


@lenient
def patient_features(
    resources: Resources, featureset: Featureset, criteria: Sequence[Criterion] = ()
) -> DataFrame:
    """One row per eligible patient."""
    table = resources["Patient"]
    own = [v for v in featureset.variables if v.resource == "Patient"]
    others = [v for v in featureset.variables if v.resource != "Patient"]
    patients = eligible_patients(resources, criteria).select(
        "pid", *[_own_value(table, v).alias(f"own_{v.column}") for v in own]
    )
    joined = _subject_features(resources, patients, others)
    columns = {v.column: F.col(f"own_{v.column}") for v in own}
    columns.update({v.column: _subject_result(v) for v in others})
    return joined.select("pid", *[columns[v.column].alias(v.column) for v in featureset.variables])


def _timed_features(encounters: DataFrame, table: ResourceTable, variables: Sequence[Variable]) -> DataFrame:
    """``encounters`` with ``own_`` columns of the variables that compare encounters.

    Each variable adds a column to the rows, and reads ``encounters`` itself, a
    written table, for what it compares them with.
    """

    def within(v: Variable) -> Column | None:
        return None if table.condition(v.query) is None else F.col(f"within_{v.column}")

    extended = encounters
    for v in variables:
        if v.kind == "readmission":
            spec = v.readmission
            extended = readmission(extended, spec.days, spec.kind, within(v), f"own_{v.column}", encounters)
    counted = {f"own_{v.column}": (v.months, within(v)) for v in variables if v.kind == "hospitalization"}
    return hospitalization_counts(extended, counted, source=encounters) if counted else extended


@lenient
def encounter_features(
    resources: Resources, featureset: Featureset, criteria: Sequence[Criterion], as_of: Column
) -> DataFrame:
    """One row per eligible encounter; ``pid`` holds the encounter's reference."""
    variables = featureset.variables
    patient_table, table = resources["Patient"], resources["Encounter"]

    def is_own(v: Variable) -> bool:
        return v.resource == "Encounter" and v.kind in ("value", "exists")

    own = [v for v in variables if is_own(v)]
    timed = [v for v in variables if v.kind in ("readmission", "hospitalization")]
    by_patient = [v for v in variables if v.resource == "Patient"]
    rest = [v for v in variables if not is_own(v) and v not in timed and v not in by_patient]

    # The cohorts are written out: several steps read them, and a shuffle straight
    # from a scan is one that can be split at run time.
    patients = materialize(
        eligible_patients(resources, criteria).select(
            "pid", *[_own_value(patient_table, v).alias(f"own_{v.column}") for v in by_patient]
        )
    )
    extra = {f"own_{v.column}": _own_value(table, v) for v in own}
    extra.update({f"within_{v.column}": _condition(table, v) for v in timed})
    encounters = eligible_encounters(resources, criteria, patients.select("pid"), as_of, extra)

    encounters = materialize(encounters)
    cohort = encounters.select(*ENCOUNTER_COLUMNS)
    encounters = _timed_features(encounters, table, timed)

    # Everything known per patient first, in one row per patient; then one join to
    # the encounters, in which patients with very many encounters are spread out.
    def key_of(v: Variable) -> str:
        return "encounter" if v.kind == "value" else v.aggregated_by

    by_subject = [v for v in rest if v.kind in ("exists", "mortality")]
    if by_patient or by_subject:
        known = _subject_features(resources, patients, by_subject).withColumnRenamed("pid", "subject")
        encounters = lookup(encounters, known, "subject", "encounter", cohort)
    # Aggregates count only resources that belong to an eligible encounter.
    aggregated = [v for v in rest if v not in by_subject]
    for (name, key, _), group in _groups(resources, aggregated, key_of).items():
        source = resources[name]
        rows = _wanted(source, group)
        if key == "subject" and group[0].kind == "aggr":
            rows = restrict_to_encounters(source, rows, cohort)
        parts = feature_aggregates(source, group, key, rows)
        if key == "subject":
            encounters = lookup(encounters, parts, key, "encounter", cohort)
        else:
            encounters = encounters.join(parts, key, "left")

    def result(v: Variable) -> Column:
        if v in own or v in timed or v in by_patient:
            return F.coalesce(F.col(f"own_{v.column}"), F.lit(0.0)) if v in timed else F.col(f"own_{v.column}")
        if v.kind == "exists" and resources[v.resource].date:
            return _result_by_end(v)
        return _subject_result(v)

    return encounters.select(
        F.col("encounter").alias("pid"), *[result(v).alias(v.column) for v in variables]
    )


def prepare_features(
    resources: Resources,
    featureset: Featureset,
    criteria: Sequence[Criterion] = (),
    as_of: Column | None = None,
) -> DataFrame:
    """The wide table of a featureset over its cohort, at the featureset's grain."""
    if featureset.encounter_grain:
        if as_of is None:
            raise ValueError("an encounter table needs as_of, the moment at which open periods end")
        wide = encounter_features(resources, featureset, criteria, as_of)
    else:
        wide = patient_features(resources, featureset, criteria)
    return conform(wide, featureset)


def conform(df: DataFrame, featureset: Featureset) -> DataFrame:
    """``pid`` and one double or string column per variable, in the order of the featureset."""
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in featureset.schema])


def known_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The requested columns that exist, unknown ones dropped."""
    present = [n for n in names if n in df.columns]
    if not present:
        raise ValueError(f"none of the requested columns exist: {list(names)}")
    return df.select(*[F.col(f"`{n}`") for n in present])
