"""Resource tables: what the extraction operators read.

A :class:`ResourceTable` is a DataFrame plus the expressions that give its
roles (own reference, subject, encounter, date ...) and its search parameters.
Nested resource JSON and flat fact tables are read alike: only the expressions
differ, and Catalyst prunes everything a query does not name.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortweave.spec import SpecError, resource_of

TOKEN = "token"  # equality or :sw prefix on a string or an array of strings
DATE = "date"  # gt, ge, lt, le, eq on a timestamp
REFERENCE = "reference"  # equality on a reference, with or without its prefix


@dataclass(frozen=True)
class SearchParameter:
    expression: str
    kind: str = TOKEN


@dataclass(frozen=True)
class ResourceTable:
    name: str
    df: DataFrame
    ref: str
    subject: str
    encounter: str | None = None
    date: str | None = None
    start: str | None = None
    end: str | None = None
    type: str | None = None
    parameters: Mapping[str, SearchParameter] = field(default_factory=dict)
    _types: dict[str, T.DataType] = field(default_factory=dict, init=False, repr=False, compare=False)

    def _type(self, expression: str) -> T.DataType:
        """Type of an expression over the table; finding it means analysing the table's plan."""
        if expression not in self._types:
            self._types[expression] = self.df.select(F.expr(expression)).schema[0].dataType
        return self._types[expression]

    @property
    def rows(self) -> DataFrame:
        """The table, aliased so that ``Observation.value`` and ``value`` both resolve."""
        return self.df.alias(self.name)

    def role(self, name: str) -> Column:
        expression = getattr(self, name)
        if expression is None:
            raise SpecError(f"{self.name} has no {name}")
        return F.expr(expression)

    def condition(self, query: str) -> Column | None:
        """The predicate of a search query, or None when it takes every row.

        ``,`` is OR within a parameter and ``&`` is AND across parameters.
        """
        if resource_of(query) != self.name:
            raise SpecError(f"{query!r} does not query {self.name}")
        text = query.partition("?")[2]
        terms = [self._term(*part.partition("=")[::2]) for part in text.split("&") if part]
        return reduce(lambda a, b: a & b, terms) if terms else None

    def _term(self, key: str, value: str) -> Column:
        name, _, modifier = key.partition(":")
        if name.startswith("_") and name != "_id":
            raise SpecError(f"{key!r} controls a result page; use resource_page or resource_count")
        parameter = self.parameters.get(name)
        if parameter is None:
            raise SpecError(f"{self.name} has no search parameter {name!r}")
        values = value.split(",")
        if parameter.kind == DATE:
            return reduce(lambda a, b: a | b, [self._date_term(parameter, v) for v in values])
        column = F.expr(parameter.expression)
        if parameter.kind == REFERENCE:
            return _one_of(column, values)
        is_array = isinstance(self._type(parameter.expression), T.ArrayType)
        if modifier == "sw":
            def starts(c: Column) -> Column:
                return reduce(lambda a, b: a | b, [c.startswith(v) for v in values])

            return F.exists(column, starts) if is_array else starts(column)
        if modifier:
            raise SpecError(f"unknown modifier in {key!r}")
        if is_array:
            return F.arrays_overlap(column, F.array(*[F.lit(v) for v in values]))
        return _one_of(column, values)

    def _date_term(self, parameter: SearchParameter, text: str) -> Column:
        column = F.expr(parameter.expression)
        prefix, moment = (text[:2], text[2:]) if text[:2].isalpha() else ("eq", text)
        bound = F.lit(moment).cast(self._type(parameter.expression))
        comparisons = {
            "gt": column > bound,
            "ge": column >= bound,
            "lt": column < bound,
            "le": column <= bound,
            "eq": column == bound,
        }
        if prefix not in comparisons:
            raise SpecError(f"unknown date prefix: {text!r}")
        return comparisons[prefix]

    def search(self, query: str) -> DataFrame:
        """All rows a query matches; the predicate reaches the file scan."""
        condition = self.condition(query)
        return self.rows if condition is None else self.rows.filter(condition)


def _one_of(column: Column, values: list[str]) -> Column:
    # An equality can be moved into the branches of a derived column, a list cannot.
    return column == values[0] if len(values) == 1 else column.isin(values)


class Resources(dict):
    """Resource tables by name."""

    @classmethod
    def of(cls, *tables: ResourceTable) -> Resources:
        return cls({t.name: t for t in tables})

    def table(self, query: str) -> ResourceTable:
        name = resource_of(query)
        try:
            return self[name]
        except KeyError:
            raise SpecError(f"no table for resource {name!r}") from None

    def search(self, query: str) -> DataFrame:
        return self.table(query).search(query)


def resource_count(resources: Resources, query: str) -> DataFrame:
    """One row: the number of resources a query matches."""
    return resources.search(query).agg(F.count(F.lit(1)).alias("total"))


def resource_page(
    resources: Resources, query: str, page: int, count: int, after: str | None = None
) -> DataFrame:
    """Page number ``page`` (from 1) of ``count`` resources, in order of their reference.

    Extraction never pages; this is for a reader who wants to look at a page. With ``after``,
    the last reference seen, pages are counted from there: a reader who goes on page by page
    asks for page 1 each time, and no earlier row is sorted or carried along.
    """
    table = resources.table(query)
    found = table.search(query)
    if after is not None:
        found = found.filter(table.role("ref") > after)
    return found.orderBy(table.role("ref")).offset((page - 1) * count).limit(count)


def latest_resource(resources: Resources, query: str) -> DataFrame:
    """The most recent match per subject (``_sort=-date&_count=1`` for every patient at once)."""
    table = resources.table(query)
    return table.search(query).groupBy(table.role("subject").alias("subject")).agg(
        F.max_by(table.role("ref"), F.struct(table.role("date"), table.role("ref"))).alias("ref"),
        F.max(table.role("date")).alias("date"),
    )


# --- nested resource JSON ---------------------------------------------------

_CODEABLE = "struct<coding: array<struct<system: string, code: string>>>"
_REFERENCE = "struct<reference: string>"
_META = "struct<profile: array<string>, versionId: string, lastUpdated: string>"

# The fields read from each kind of nested resource.
RESOURCE_SCHEMAS = {
    "Patient": f"""resourceType string, id string, meta {_META},
        identifier array<struct<system: string, value: string>>, gender string,
        birthDate string, address array<struct<country: string>>""",
    "Encounter": f"""resourceType string, id string, meta {_META}, subject {_REFERENCE},
        period struct<start: string, end: string>, type array<{_CODEABLE}>""",
    "Observation": f"""resourceType string, id string, meta {_META}, status string,
        code {_CODEABLE}, subject {_REFERENCE}, encounter {_REFERENCE},
        effectiveDateTime string,
        valueQuantity struct<value: double, unit: string, system: string, code: string>""",
    "Condition": f"""resourceType string, id string, meta {_META}, code {_CODEABLE},
        subject {_REFERENCE}, encounter {_REFERENCE}, onsetDateTime string""",
    "MedicationStatement": f"""resourceType string, id string, meta {_META}, status string,
        medicationCodeableConcept {_CODEABLE}, subject {_REFERENCE}, context {_REFERENCE},
        effectiveDateTime string""",
}


def _moment(field_name: str) -> str:
    return f"try_cast({field_name} as timestamp)"


def nested_table(name: str, df: DataFrame) -> ResourceTable:
    """Roles and search parameters of a nested resource of kind ``name``."""
    ref = f"concat('{name}/', id)"
    common = {"_id": SearchParameter("id", REFERENCE)}
    subject = {"subject": SearchParameter("subject.reference", REFERENCE)}
    if name == "Patient":
        return ResourceTable(
            name, df, ref=ref, subject=ref,
            parameters={
                **common,
                "gender": SearchParameter("gender"),
                "identifier": SearchParameter("identifier.value"),
                "address-country": SearchParameter("address.country"),
                "birthdate": SearchParameter(_moment("birthDate"), DATE),
            },
        )
    if name == "Encounter":
        # try_element_at gives null where the list is empty or missing.
        first_type = "try_element_at(try_element_at(type, 1).coding, 1).code"
        return ResourceTable(
            name, df, ref=ref, subject="subject.reference", encounter=ref,
            date=_moment("period.start"), start=_moment("period.start"),
            end=_moment("period.end"), type=first_type,
            parameters={
                **common, **subject,
                "type": SearchParameter("flatten(transform(type, t -> t.coding.code))"),
                "date": SearchParameter(_moment("period.start"), DATE),
            },
        )
    layouts = {
        "Observation": ("code", "encounter", "effectiveDateTime"),
        "Condition": ("code", "encounter", "onsetDateTime"),
        "MedicationStatement": ("medicationCodeableConcept", "context", "effectiveDateTime"),
    }
    if name not in layouts:
        raise SpecError(f"no layout for resource {name!r}")
    code, encounter, date = layouts[name]
    return ResourceTable(
        name, df, ref=ref, subject="subject.reference", encounter=f"{encounter}.reference",
        date=_moment(date),
        parameters={
            **common, **subject,
            "code": SearchParameter(f"{code}.coding.code"),
            encounter: SearchParameter(f"{encounter}.reference", REFERENCE),
            "date": SearchParameter(_moment(date), DATE),
        },
    )


def read_resource_lines(spark: SparkSession, path: str, name: str) -> tuple[ResourceTable, DataFrame]:
    """Resources of one kind from line-delimited JSON, and the lines that are not valid.

    A malformed line does not fail the read; it goes to the second frame.
    """
    lines = spark.read.text(path)
    schema = f"{RESOURCE_SCHEMAS[name]}, _corrupt string"
    parsed = lines.select(
        "value",
        F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"),
    )
    valid = parsed.filter("r._corrupt is null and r.id is not null").select("r.*").drop("_corrupt")
    rejects = parsed.filter("r._corrupt is not null or r.id is null").select(F.col("value").alias("line"))
    return nested_table(name, valid), rejects


# A resource inside a bundle stays JSON text until its kind is known.
BUNDLE_SCHEMA = """entry array<struct<resource: string, request: struct<method: string, url: string>>>,
    link array<struct<relation: string>>, total bigint"""


# What tells whether an entry can be used.
_GLANCE = "entry array<struct<resource: struct<resourceType: string, id: string>, request: struct<method: string>>>"


def _any_resource() -> T.StructType:
    """The fields of all kinds of resources; one that several have is of one type."""
    fields: dict[str, T.StructField] = {}
    for schema in RESOURCE_SCHEMAS.values():
        for f in T.StructType.fromDDL(schema):
            if fields.setdefault(f.name, f).dataType != f.dataType:
                raise SpecError(f"{f.name!r} is of several types")
    return T.StructType(list(fields.values()))


def flatten_bundles(bundles: DataFrame, column: str = "value", parsed: bool = False) -> DataFrame:
    """``entry[].resource`` of bundles held as JSON text: kind, method, url, resource text.

    With ``parsed`` the resources of a bundle are parsed with it, into a column ``fields``, and have no text; where
    anything in a bundle does not fit its place, they are text as without, and have no fields.
    """
    text = F.from_json(F.col(column), BUNDLE_SCHEMA)["entry"]
    if not parsed:
        entries = bundles.select(F.explode(text).alias("e"))
        return entries.select(
            F.get_json_object("e.resource", "$.resourceType").alias("kind"),
            F.col("e.request.method").alias("method"),
            F.col("e.request.url").alias("url"),
            F.col("e.resource").alias("resource"),
        )
    resource = _any_resource()
    request = T.StructType.fromDDL("method string, url string")
    entry = T.StructType([T.StructField("resource", resource), T.StructField("request", request)])
    schema = T.StructType([T.StructField("entry", T.ArrayType(entry)), T.StructField("_corrupt", T.StringType())])
    told = bundles.select(F.col(column), F.from_json(column, schema, {"columnNameOfCorruptRecord": "_corrupt"}).alias("_b"))

    def made(e: Column, kind: Column, text: Column, fields: Column) -> Column:
        method, url = e["request"]["method"], e["request"]["url"]
        return F.struct(kind.alias("kind"), method.alias("method"), url.alias("url"), text.alias("resource"), fields.alias("fields"))

    sound = F.transform("_b.entry", lambda e: made(e, e["resource"]["resourceType"], F.lit(None).cast("string"), e["resource"]))
    other = F.transform(text, lambda e: made(e, F.get_json_object(e["resource"], "$.resourceType"), e["resource"], F.lit(None).cast(resource)))
    entries = told.select(F.explode(F.when(F.col("_b._corrupt").isNull(), sound).otherwise(other)).alias("e"))
    return entries.select("e.*")


def resources_from_bundles(entries: DataFrame, names: list[str] | None = None) -> Resources:
    """Nested tables out of flattened bundle entries, parsed or not.

    Entries that delete, and resources without an id, are no data; see :func:`bundle_rejects`.
    """
    kept = entries.filter(F.coalesce(F.col("method"), F.lit("PUT")) != "DELETE")
    tables = []
    for name in names or list(RESOURCE_SCHEMAS):
        own = kept.filter(F.col("kind") == name)
        text = F.from_json("resource", RESOURCE_SCHEMAS[name])
        if "fields" in entries.columns:
            # Field by field, so that of stored entries only those are read that are asked for.
            fields = T.StructType.fromDDL(RESOURCE_SCHEMAS[name]).names
            of = lambda f: F.when(F.col("resource").isNull(), F.col(f"fields.{f}")).otherwise(text[f])  # noqa: B023, E731
            tables.append(nested_table(name, own.select(*[of(f).alias(f) for f in fields]).filter("id is not null")))
        else:
            parsed = own.select(text.alias("r"))
            tables.append(nested_table(name, parsed.filter("r.id is not null").select("r.*")))
    return Resources.of(*tables)


def bundle_rejects(bundles: DataFrame, column: str = "value") -> DataFrame:
    """``(line, reason)``: bundles that are not valid, and entries whose resource cannot be used."""
    # Most bundles have nothing to reject, which their kinds and ids tell without the text of their entries.
    glance = F.from_json(F.col(column), _GLANCE)["entry"]
    deleted = lambda e: F.coalesce(e["request"]["method"], F.lit("PUT")) == "DELETE"
    known = lambda e: e["resource"]["resourceType"].isin(*RESOURCE_SCHEMAS) & e["resource"]["id"].isNotNull()
    usable = F.forall(glance, lambda e: F.coalesce(e.isNotNull() & (deleted(e) | known(e)), F.lit(False)))
    suspected = bundles.filter(~F.coalesce(usable, F.lit(False)))
    parsed = suspected.select(F.col(column).alias("line"), F.from_json(F.col(column), BUNDLE_SCHEMA)["entry"].alias("entry"))
    # The text of a bundle goes with its entries only where it is not valid: it has one row then.
    whole = F.when(F.col("entry").isNull(), F.col("line")).alias("line")
    none = F.array(F.lit(None).cast("struct<resource: string, request: struct<method: string, url: string>>"))
    entries = parsed.select(F.col("entry").isNull().alias("broken"), whole, F.explode(F.coalesce("entry", none)).alias("e"))
    kind, has_id = (F.get_json_object("e.resource", path) for path in ("$.resourceType", "$.id"))
    reason = (
        F.when(F.col("broken"), "not a bundle")
        .when(F.coalesce(F.col("e.request.method"), F.lit("PUT")) == "DELETE", None)
        .when(~F.coalesce(kind.isin(*RESOURCE_SCHEMAS), F.lit(False)), "unknown kind of resource")
        .when(has_id.isNull(), "no id")
    )
    line = F.when(F.col("broken"), F.col("line")).otherwise(F.col("e.resource")).alias("line")
    return entries.withColumn("reason", reason).filter("reason is not null").select(line, "reason")


def read_bundle_files(spark: SparkSession, path: str) -> DataFrame:
    """Bundle files (one JSON document each) as JSON text, for :func:`flatten_bundles`."""
    return spark.read.text(path, wholetext=True)


def last_entries(entries: DataFrame, key: str, version: str, source: str | None = None) -> DataFrame:
    """Per key the last of ``entries`` (with ``method``), by a total order, so that no layout changes it.

    The highest ``version`` is last; of one version DELETE comes after PUT, then the higher ``source``,
    then the larger row, column by column (a null before any value). Rows without a key are no entries.
    One aggregation: it combines before the shuffle, so a key with very many versions does not gather
    in one task.
    """
    columns = [c for c in entries.columns if c != source]
    ranks = [F.col(version), F.col("method") == "DELETE"] + ([F.col(source)] if source else [])
    order = F.struct(*ranks, *[F.col(c) for c in columns])
    last = entries.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"))
    return last.agg(F.max_by(F.struct(*columns), order).alias("last")).select("last.*")


def upsert(store: DataFrame, batch: DataFrame, key: str, version: str) -> DataFrame:
    """Apply a batch of PUT and DELETE entries to a table of resources.

    ``batch`` has the columns of ``store`` and ``method``. Per key the last entry stays, in the order
    of :func:`last_entries`, where an entry of the batch comes after the stored row of the same
    version; a key whose last entry is DELETE disappears.
    """
    columns = store.columns
    stored = store.withColumns({"method": F.lit("PUT"), "_batch": F.lit(0)})
    unioned = stored.unionByName(batch.select(*columns, "method").withColumn("_batch", F.lit(1)))
    return last_entries(unioned, key, version, "_batch").filter("method = 'PUT'").select(*columns)


def with_rows(table: ResourceTable, df: DataFrame) -> ResourceTable:
    """The same layout over other rows."""
    return replace(table, df=df)
