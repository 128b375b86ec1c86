"""The tables as pages of nested resources, and what is prepared from such pages alone."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.plans.prepare import prepare_dataset
from cohortweave.session import materialize
from cohortweave.sources import pages
from cohortweave.sources import resources as S
from cohortweave.sources.store import DatasetStore
from cohortweave.spec import CATEGORICAL, DEPENDENT, Criterion, Featureset, Variable
from workload import tables
from workload.extraction import BUNDLE_PAGE, PREPARE_COHORT_SQL, WIDE_SQL, _new_folder
from workload.registry import query
from workload.tables import DEATH, ENC, MED, OBS, PAT, with_sql


def _entry(kind: str, id_: Column | None, method: str = "PUT", **fields: Column) -> Column:
    """An entry of a bundle; nulls are left out of its JSON text."""
    id_ = F.lit(None).cast("string") if id_ is None else id_
    resource = F.struct(F.lit(kind).alias("resourceType"), id_.alias("id"), *[c.alias(n) for n, c in fields.items()])
    request = F.struct(F.lit(method).alias("method"), F.concat(F.lit(f"{kind}/"), F.coalesce(id_, F.lit(""))).alias("url"))
    return F.struct(resource.alias("resource"), request.alias("request"))


def _coded(code: Column) -> Column:
    return F.struct(F.array(F.struct(code.alias("code"))).alias("coding"))


def _searches(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, Column, dict[str, Callable[[Column], list[Column]]]]]:
    """Rows, the number that deals them out to pages, and by search the entries that are made of a row."""
    flat = tables.resources(spark, sf_dir)
    text = lambda c: c.cast("string")
    to = lambda c: F.struct(c.alias("reference"))

    def patient(r: Column) -> list[Column]:
        names = F.array(
            F.struct(F.lit("segment").alias("system"), r["segment"].alias("value")),
            F.struct(F.lit("site").alias("system"), r["site"].alias("value")),
        )
        return [_entry("Patient", r["id"], identifier=names, address=r["address"])]

    def vitals(r: Column) -> list[Column]:
        return [
            _entry(
                "Observation", F.concat(F.lit(f"{name}-"), r["id"]), code=_coded(F.lit(name)),
                subject=to(F.concat(F.lit("Patient/"), r["id"])), valueQuantity=F.struct(r[name].alias("value")),
            )
            for name in ("age", "balance")
        ]

    def retired(r: Column) -> list[Column]:
        """Resources that were deleted, and some without an id."""
        return [_entry("Patient", F.concat(F.lit("gone-"), r["id"]), "DELETE"), _entry("Patient", None)]

    def observation(r: Column) -> list[Column]:
        value = F.struct(r["value"].alias("value"))
        return [_entry("Observation", r["id"], code=_coded(r["code"]), subject=to(r["patient"]), effectiveDateTime=text(r["date"]), valueQuantity=value)]

    def encounter(r: Column) -> list[Column]:
        period = F.struct(text(r["period_start"]).alias("start"), text(r["period_end"]).alias("end"))
        return [_entry("Encounter", r["id"], subject=to(r["patient"]), type=F.array(_coded(r["kind"])), period=period)]

    def statement(kind: str, value: str, code: str, context: str, date: str) -> Callable[[Column], list[Column]]:
        def made(r: Column) -> list[Column]:
            told = tables.statement_columns(r.getField)
            fields = {code: _coded(r[value]), "subject": to(told["patient"]), context: to(told["context"]), date: text(told["date"])}
            return [_entry(kind, told["id"], **fields)]

        return made

    number = F.col("id").cast("long")
    statements = {
        "MedicationStatement": statement("MedicationStatement", "p_brand", "medicationCodeableConcept", "context", "effectiveDateTime"),
        "Condition": statement("Condition", "p_type", "code", "encounter", "onsetDateTime"),
    }
    return [
        (
            flat["Patient"].df.select("id", "segment", "site", "address", "age", "balance"), number,
            {"Patient": patient, "Observation?vital": vitals, "Patient?retired": retired},
        ),
        # A death is named by its patient.
        (
            flat["Observation"].df.select("id", "patient", "code", "date", "value"), F.regexp_extract("id", "[0-9]+", 0).cast("long"),
            {"Observation": observation},
        ),
        (flat["Encounter"].df.select("id", "patient", "kind", "period_start", "period_end"), number, {"Encounter": encounter}),
        (tables.statement_lines(spark, sf_dir), F.col("l_orderkey").cast("long"), statements),
    ]


def _filled(rows: DataFrame, number: Column, searches: dict[str, Callable[[Column], list[Column]]]) -> DataFrame:
    """Pages that have entries: ``search``, ``page``, ``entries`` as text, and their number ``n``.

    Rows are gathered by page as they are, and only then written out as text, for all searches made of them.
    """
    gathered = rows.select(F.floor(number / BUNDLE_PAGE).alias("page"), F.struct("*").alias("row")).groupBy("page").agg(F.collect_list("row").alias("rows"))

    def text(entries: Callable[[Column], list[Column]]) -> Column:
        return F.to_json(F.flatten(F.transform("rows", lambda r: F.array(*entries(r)))))

    parts = [
        F.struct(F.lit(name).alias("search"), text(entries).alias("entries"), (F.size("rows") * F.lit(len(entries(F.col("_"))))).cast("long").alias("n"))
        for name, entries in searches.items()
    ]  # one for each of a few searches
    return gathered.select("page", F.explode(F.array(*parts)).alias("s")).select("s.search", "page", "s.entries", "s.n")


def bundle_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All resources as pages of bundles, held as JSON text; the pages of a search name each other.

    The text is written once, compressed; links and totals are put to it when it is read.
    """
    filled = materialize(reduce(DataFrame.unionByName, [_filled(*s) for s in _searches(spark, sf_dir)]), compression="zstd")
    extent = materialize(filled.groupBy("search").agg(F.sum("n").alias("total"), F.max("page").alias("last")))
    every = extent.select("search", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("page"))
    empty = materialize(every.join(filled, ["search", "page"], "left_anti")).withColumn("entries", F.lit("[]"))
    kept = F.col("page").between(F.least(F.lit(0), "last"), F.greatest(F.lit(0), "last"))
    each = filled.select("search", "page", "entries").unionByName(empty).join(extent, "search").filter(kept)
    address = lambda n: F.concat(F.col("search"), F.lit("#"), n.cast("string"))
    link = lambda relation, url: F.struct(F.lit(relation).alias("relation"), url.alias("url"))
    links = F.array_compact(
        F.array(link("self", address(F.col("page"))), F.when(F.col("page") < F.col("last"), link("next", address(F.col("page") + 1))))
    )
    text = F.concat(
        F.lit('{"resourceType":"Bundle","entry":'), F.col("entries"), F.lit(',"link":'), F.to_json(links),
        F.lit(',"total":'), F.col("total").cast("string"), F.lit("}"),
    )
    return each.select(text.alias("value"))


SEARCHES_SQL = """searches as (
  select 'Patient' as search, count(*) as n, max(c_custkey) as last from customer
  union all select 'Observation?vital', 2 * count(*), max(c_custkey) from customer
  union all select 'Patient?retired', 2 * count(*), max(c_custkey) from customer
  union all select 'Encounter', count(*), max(o_orderkey) from orders
  union all select 'MedicationStatement', count(*), max(cast(substr(enc, 11) as bigint)) from med
  union all select 'Condition', count(*), max(cast(substr(enc, 11) as bigint)) from med
  union all select 'Observation', (select count(*) from events) + (select count(*) from death),
    greatest((select max(event_id) from events), (select max(cast(substr(subj, 9) as bigint)) from death))
)"""


@query(
    "bundle_page_chains",
    with_sql(MED, DEATH, SEARCHES_SQL)
    + f"""select search || '#0' as chain, cast(last // {BUNDLE_PAGE} + 1 as bigint) as pages,
      cast(last // {BUNDLE_PAGE} as bigint) as last_position, cast(n as bigint) as entries, cast(n as bigint) as total,
      cast(0 as bigint) as problems from searches""",
)
def bundle_page_chains(spark, sf_dir):
    """Every page followed to the first one of its search, the entries counted against the total."""
    chains = materialize(pages.page_chains(bundle_pages(spark, sf_dir)))
    problems = pages.chain_problems(chains).groupBy("chain").agg(F.count(F.lit(1)).alias("problems"))
    found = chains.groupBy("chain").agg(
        F.count(F.lit(1)).alias("pages"), F.max("position").alias("last_position"), F.sum("entries").alias("entries"), F.max("total").alias("total")
    )
    return found.join(problems, "chain", "left").na.fill(0, ["problems"])


@query("bundle_rejects", "select 'no id' as reason, count(*) as entries from customer")
def bundle_rejects(spark, sf_dir):
    return S.bundle_rejects(bundle_pages(spark, sf_dir)).groupBy("reason").agg(F.count(F.lit(1)).alias("entries"))


SEGMENT = "get(filter(identifier, i -> i.system = 'segment'), 0).value"
NESTED = Featureset(
    (
        Variable("segment", "/Patient", f"value:nullif({SEGMENT}, 'BUILDING')", CATEGORICAL),
        Variable("age", "/Observation?code=age", "value:Observation.valueQuantity.value"),
        Variable("balance", "/Observation?code=balance", "value:case when valueQuantity.value >= 0 then valueQuantity.value end"),
        Variable("number of medications", "/MedicationStatement", "aggr:count"),
        Variable("brand #12", "/MedicationStatement?code=Brand#12", "value:exists"),
        Variable("economy", "/Condition?code:sw=ECO", "value:exists"),
        Variable("purchase", "/Observation?code=purchase", "value:Observation.valueQuantity.value"),
        Variable("deceased", "/Observation?code=death", "value:mortality:6", role=DEPENDENT),
    )
)
NESTED_CRITERIA = (
    Criterion("/Observation?code=balance", "satisfy:valueQuantity.value > -500"),
    Criterion("/MedicationStatement?code=Brand#12,Brand#23,Brand#4"),
    Criterion("/Condition", "aggr:count(1) >= 10"),
)


@query(
    "prepare_dataset_bundles",
    with_sql(PAT, ENC, MED, OBS, DEATH, WIDE_SQL, PREPARE_COHORT_SQL)
    + "select wide.* from wide semi join chosen on wide.pid = chosen.pid",
)
def prepare_dataset_bundles(spark, sf_dir):
    """From pages of nested resources to the stored dataset: chains checked, entries taken out, cohort, variables."""
    bundles = bundle_pages(spark, sf_dir)
    sound = pages.sound_bundles(bundles, materialize(pages.page_chains(bundles)))
    resources = S.resources_from_bundles(materialize(S.flatten_bundles(sound, parsed=True), compression="zstd"))
    store = DatasetStore(spark, _new_folder(spark))
    as_of = F.lit(tables.AS_OF_TEXT).cast("timestamp")
    return prepare_dataset(spark, resources, NESTED, NESTED_CRITERIA, store, "nested", as_of).dataset
