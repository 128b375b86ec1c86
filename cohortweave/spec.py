"""Declarative description of a feature table: variables and eligibility criteria.

A *query* picks resources: ``/Observation?code=lab-glucose``. A *path* says what to
take from them, as a prefix followed by a Spark SQL expression over the
resource's columns:

===============================  ===============================================
``value:<expr>``                 first value per patient or encounter
``value:exists``                 1.0 if any resource matches
``value:readmission:[t:]<days>`` readmission flag, type 1 or 2 (default 2)
``value:hospitalization:<m>``    earlier stays within m calendar months
``value:mortality:<m>``          encounter dated after (observation - m months)
``aggr:<fn>[:<expr>]``           fn in count, sum, avg, min, max; also written
                                 ``aggr:groupBy(<Resource>.subject.reference,<fn>(<expr>))``
``aggr:exists:<predicate>``      1.0 where the aggregate predicate holds
``satisfy:<predicate>``          criteria: keep resources that satisfy it
``aggr:<predicate>``             criteria: keep patients whose group satisfies it
===============================  ===============================================
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import types as T

# Path prefixes, data types, variable roles, characters that a
# column name may not hold, months used when a mortality path has no number.
AGGREGATION = "aggr:"
AGGREGATION_EXISTENCE = "aggr:exists:"
VALUE = "value:"
SATISFY = "satisfy:"
VALUE_READMISSION = "value:readmission:"
VALUE_HOSPITALIZATION = "value:hospitalization:"
VALUE_MORTALITY = "value:mortality:"
NUMERIC = "numeric"
CATEGORICAL = "categorical"
INDEPENDENT = "independent"
DEPENDENT = "dependent"
INVALID_NAME_CHARACTERS = r"""[\s`*{}\[\]()>#+:~'%^&@<?;,"!$=|.]"""
DEFAULT_MORTALITY_MONTHS = 6

AGGREGATE_FUNCTIONS = ("count", "sum", "avg", "min", "max")
GROUPED_AGGREGATE = re.compile(r"groupBy\(\s*\w+\.(subject|encounter|context)\.reference\s*,\s*(\w+)\((.*)\)\s*\)")


class SpecError(ValueError):
    """The featureset or the criteria cannot be prepared."""


def resource_of(query: str) -> str:
    """``/Observation?code=x`` -> ``Observation``."""
    return query.lstrip("/").partition("?")[0]


def sanitize(name: str) -> str:
    """Column name of a variable: its name without the invalid characters."""
    return re.sub(INVALID_NAME_CHARACTERS, "", name.strip())


@dataclass(frozen=True)
class Readmission:
    days: int
    kind: int = 2

    @classmethod
    def parse(cls, text: str) -> Readmission:
        parts = text.split(":")
        try:
            if len(parts) == 1:
                return cls(int(parts[0]))
            kind = int(parts[0])
            return cls(int(parts[1]), kind if kind in (1, 2) else 2)
        except ValueError as error:
            raise SpecError(f"not a readmission path: {text!r}") from error


@dataclass(frozen=True)
class Variable:
    name: str
    query: str
    path: str
    data_type: str = NUMERIC
    role: str = INDEPENDENT
    # Which reference an ``aggr:`` variable groups by: subject or encounter.
    group_by: str = "subject"

    @property
    def column(self) -> str:
        return sanitize(self.name)

    @property
    def resource(self) -> str:
        return resource_of(self.query)

    @property
    def is_categorical(self) -> bool:
        return self.data_type == CATEGORICAL

    @property
    def kind(self) -> str:
        if self.path.startswith(AGGREGATION_EXISTENCE):
            return "aggr_exists"
        if self.path.startswith(AGGREGATION):
            return "aggr"
        if self.path.startswith(VALUE_READMISSION):
            return "readmission"
        if self.path.startswith(VALUE_HOSPITALIZATION):
            return "hospitalization"
        if self.path.startswith(VALUE_MORTALITY):
            return "mortality"
        if self.path.strip() == VALUE + "exists":
            return "exists"
        if self.path.startswith(VALUE):
            return "value"
        raise SpecError(f"unknown path prefix in variable {self.name!r}: {self.path!r}")

    @property
    def expression(self) -> str:
        """What follows the prefix."""
        prefixes = {
            "aggr_exists": AGGREGATION_EXISTENCE,
            "aggr": AGGREGATION,
            "readmission": VALUE_READMISSION,
            "hospitalization": VALUE_HOSPITALIZATION,
            "mortality": VALUE_MORTALITY,
        }
        return self.path[len(prefixes.get(self.kind, VALUE)) :].strip()

    @property
    def aggregate(self) -> tuple[str, str | None]:
        """Function and argument of an ``aggr:`` path."""
        grouped = GROUPED_AGGREGATE.fullmatch(self.expression)
        if grouped:
            function, argument = grouped[2], grouped[3].strip()
        else:
            function, _, argument = self.expression.partition(":")
        if function not in AGGREGATE_FUNCTIONS:
            raise SpecError(f"unknown aggregate in variable {self.name!r}: {function!r}")
        return function, argument or None

    @property
    def aggregated_by(self) -> str:
        """Role of the reference an ``aggr:`` variable groups by: subject or encounter."""
        grouped = GROUPED_AGGREGATE.fullmatch(self.expression)
        if grouped:
            return "subject" if grouped[1] == "subject" else "encounter"
        return self.group_by

    @property
    def readmission(self) -> Readmission:
        return Readmission.parse(self.expression)

    @property
    def months(self) -> int:
        try:
            return int(self.expression)
        except ValueError:
            if self.kind == "mortality":
                return DEFAULT_MORTALITY_MONTHS
            raise SpecError(f"not a number of months: {self.path!r}") from None


@dataclass(frozen=True)
class Criterion:
    query: str
    path: str | None = None

    @property
    def resource(self) -> str:
        return resource_of(self.query)

    @property
    def kind(self) -> str:
        if not self.path:
            return "any"
        if self.resource == "Encounter" and self.path.startswith(VALUE_READMISSION):
            return "readmission"
        if self.path.startswith(AGGREGATION):
            return "aggr"
        if self.path.startswith(SATISFY):
            return "satisfy"
        raise SpecError(f"unknown path prefix in criterion: {self.path!r}")

    @property
    def expression(self) -> str:
        prefix = {"aggr": AGGREGATION, "satisfy": SATISFY, "readmission": VALUE_READMISSION}
        return self.path[len(prefix[self.kind]) :].strip()


@dataclass(frozen=True)
class Featureset:
    variables: Sequence[Variable] = field(default_factory=tuple)

    @property
    def encounter_grain(self) -> bool:
        """One row per encounter if any variable is about encounters, else per patient."""
        return any(
            "hospitalization" in v.path or "readmission" in v.path or v.query.startswith("/Encounter")
            for v in self.variables
        )

    @property
    def schema(self) -> T.StructType:
        """``pid`` and one double or string column per variable, in order."""
        schema = T.StructType([T.StructField("pid", T.StringType(), False)])
        for v in self.variables:
            schema.add(v.column, T.StringType() if v.is_categorical else T.DoubleType())
        return schema

    @property
    def numeric(self) -> list[str]:
        return [v.column for v in self.variables if not v.is_categorical]

    @property
    def categorical(self) -> list[str]:
        return [v.column for v in self.variables if v.is_categorical]

    @property
    def independent(self) -> list[Variable]:
        return [v for v in self.variables if v.role == INDEPENDENT]

    @property
    def dependent(self) -> Variable | None:
        return next((v for v in self.variables if v.role == DEPENDENT), None)


def from_request(request: Mapping) -> tuple[Featureset, list[Criterion]]:
    """Featureset and criteria of a preparation request given as a parsed JSON document."""
    variables = [
        Variable(v["name"], v["fhir_query"], v["fhir_path"], v["variable_data_type"], v["variable_type"])
        for v in request["featureset"]["variables"]
    ]
    criteria = [Criterion(c["fhir_query"], c.get("fhir_path")) for c in request.get("eligibility_criteria", ())]
    return Featureset(variables), criteria


def validate(featureset: Featureset, criteria: Sequence[Criterion] = ()) -> None:
    """Raise ``SpecError`` for anything that could not be prepared."""
    if not featureset.variables:
        raise SpecError("the featureset has no variables")
    columns = [v.column for v in featureset.variables]
    if len(set(columns)) < len(columns) or "pid" in columns:
        raise SpecError(f"variable names must give distinct columns other than pid: {columns}")
    if sum(c.resource == "Patient" for c in criteria) > 1:
        raise SpecError("at most one criterion may be on Patient")
    for criterion in criteria:
        if criterion.kind == "readmission":
            Readmission.parse(criterion.expression)
    for v in featureset.variables:
        if v.kind in ("hospitalization", "mortality"):
            v.months  # noqa: B018 - parsed for its error
        if v.kind == "readmission":
            v.readmission  # noqa: B018 - parsed for its error
        if v.kind in ("readmission", "hospitalization") and v.resource != "Encounter":
            raise SpecError(f"variable {v.name!r} must query /Encounter")
        if v.kind == "mortality" and v.resource != "Observation":
            raise SpecError(f"variable {v.name!r} must query /Observation")
        if v.kind == "aggr":
            v.aggregate  # noqa: B018 - parsed for its error
        if v.is_categorical and v.kind != "value":
            raise SpecError(f"variable {v.name!r} is categorical, but {v.path!r} gives numbers")
