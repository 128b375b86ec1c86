"""Sources, predicates, cohorts and features."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cohortweave.functions.expressions import age_in_years, sanitized
from cohortweave.operators import cohort as C
from cohortweave.operators import encounters as E
from cohortweave.operators.features import known_columns, prepare_features
from cohortweave.plans.prepare import prepare_dataset
from cohortweave.session import shared_dir
from cohortweave.sources import resources as S
from cohortweave.sources.store import DatasetStore, ResourceStore, read_sites
from cohortweave.spec import CATEGORICAL, DEPENDENT, Criterion, Featureset, Variable
from workload import tables
from workload.registry import query
from workload.tables import DEATH, ENC, EVERY_OBS, MED, OBS, PAT, day, with_sql


def _text_day(column: str):
    return F.date_format(column, "yyyy-MM-dd")


def _new_folder(spark) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


# --- sources ----------------------------------------------------------------


@query(
    "resource_scan",
    with_sql(ENC) + f"select enc as ref, subj as subject, {day('st')} as start from enc "
    "where ty = 'unplanned' and st > timestamp '1998-06-30'",
)
def resource_scan(spark, sf_dir):
    table = tables.encounters(spark, sf_dir)
    found = table.search("/Encounter?type=unplanned&date=gt1998-06-30")
    return found.select("ref", F.col("patient").alias("subject"), _text_day("period_start").alias("start"))


BUNDLE_PAGE = 20


@query(
    "bundle_flatten",
    "select cast(event_id as varchar) as id, 'Patient/' || user_id as subject, event_type as code, value from events",
)
def bundle_flatten(spark, sf_dir):
    """Events put into bundles of one page each, then taken out again."""
    events = tables.table(spark, sf_dir, "events")

    def codeable(code):
        return F.struct(F.array(F.struct(code.alias("code"))).alias("coding"))

    resource = F.struct(
        F.lit("Observation").alias("resourceType"),
        F.col("event_id").cast("string").alias("id"),
        codeable(F.col("event_type")).alias("code"),
        F.struct(F.concat(F.lit("Patient/"), F.col("user_id")).alias("reference")).alias("subject"),
        F.struct(F.col("value")).alias("valueQuantity"),
    )
    pages = events.groupBy(F.floor(F.col("event_id") / BUNDLE_PAGE)).agg(
        F.collect_list(F.struct(resource.alias("resource"))).alias("entry")
    )
    bundles = pages.select(F.to_json(F.struct("entry", F.size("entry").alias("total"))).alias("value"))
    observation = S.resources_from_bundles(S.flatten_bundles(bundles), ["Observation"])["Observation"]
    return observation.rows.select(
        "id",
        observation.role("subject").alias("subject"),
        F.expr("code.coding[0].code").alias("code"),
        F.expr("valueQuantity.value").alias("value"),
    )


COUNTED = {
    "unplanned": "/Encounter?type=unplanned",
    "urgent or low": "/Encounter?priority=1-URGENT,5-LOW",
    "brand twelve": "/MedicationStatement?code=Brand#12",
    "all patients": "/Patient",
}


@query(
    "resource_count",
    with_sql(ENC, MED)
    + """select 'unplanned' as search, count(*) as total from enc where ty = 'unplanned'
    union all select 'urgent or low', count(*) from enc where priority in ('1-URGENT', '5-LOW')
    union all select 'brand twelve', count(*) from med where brand = 'Brand#12'
    union all select 'all patients', count(*) from customer""",
)
def resource_count(spark, sf_dir):
    resources = tables.resources(spark, sf_dir)
    counts = [
        S.resource_count(resources, text).select(F.lit(name).alias("search"), "total")
        for name, text in COUNTED.items()
    ]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result


@query(
    "resource_page",
    with_sql(ENC) + "select enc as ref, subj as subject from enc where ty = 'unplanned' order by enc limit 20 offset 40",
)
def resource_page(spark, sf_dir):
    resources = tables.resources(spark, sf_dir)
    page = S.resource_page(resources, "/Encounter?type=unplanned", page=3, count=20)
    return page.select("ref", F.col("patient").alias("subject"))


@query(
    "latest_resource",
    with_sql(ENC)
    + f"""select subj as subject, enc as ref, {day('st')} as date from
    (select *, row_number() over (partition by subj order by st desc, enc desc) as rn from enc) where rn = 1""",
)
def latest_resource(spark, sf_dir):
    latest = S.latest_resource(tables.resources(spark, sf_dir), "/Encounter")
    return latest.select("subject", "ref", _text_day("date").alias("date"))


UPSERTED_SQL = """with store as (select c_custkey as id, c_acctbal as balance, timestamp '1990-01-01' as updated, 'PUT' as method
                      from customer),
    batch as (select o_custkey as id, o_totalprice as balance, o_orderdate as updated,
                     case when o_orderstatus = 'P' then 'DELETE' else 'PUT' end as method
              from orders),
    ranked as (select *, row_number() over (partition by id order by updated desc, method, balance desc) as rn
               from (select * from store union all select * from batch))
    select id, balance, strftime(updated, '%Y-%m-%d') as updated from ranked where rn = 1 and method = 'PUT'"""


def _versions(spark, sf_dir):
    """Customers as stored resources, and orders as entries that change or delete them."""
    customer, orders = tables.table(spark, sf_dir, "customer"), tables.table(spark, sf_dir, "orders")
    start = F.lit("1990-01-01").cast("timestamp_ntz")
    store = customer.select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), start.alias("updated")
    )
    batch = orders.select(
        F.col("o_custkey").alias("id"),
        F.col("o_totalprice").alias("balance"),
        F.col("o_orderdate").alias("updated"),
        F.when(F.col("o_orderstatus") == "P", "DELETE").otherwise("PUT").alias("method"),
    )
    return store, batch


@query("bundle_upsert", UPSERTED_SQL)
def bundle_upsert(spark, sf_dir):
    state = S.upsert(*_versions(spark, sf_dir), key="id", version="updated")
    return state.withColumn("updated", _text_day("updated"))


@query("bundle_upsert_batches", UPSERTED_SQL)
def bundle_upsert_batches(spark, sf_dir):
    """The same in three batches of a store by buckets, the newer orders before the older ones."""
    stored, orders = _versions(spark, sf_dir)
    store = ResourceStore(spark, _new_folder(spark), "id", "updated", buckets=8)
    newer = F.col("updated") >= F.lit("1998-01-01").cast("timestamp_ntz")
    for batch in (stored.withColumn("method", F.lit("PUT")), orders.filter(newer), orders.filter(~newer)):
        store.apply(batch)
    return store.read().withColumn("updated", _text_day("updated"))


LIGHT = Featureset(
    (
        Variable("segment", "/Patient", "value:nullif(segment, 'BUILDING')", CATEGORICAL),
        Variable("age", "/Patient", "value:age"),
        Variable("balance", "/Patient", "value:case when balance >= 0 then balance end"),
    )
)

LIGHT_SQL = """light as (
  select pid, site, nullif(segment, 'BUILDING') as segment, age,
         case when balance >= 0 then balance end as balance from pat)"""


def light(spark, sf_dir):
    """A small prepared dataset with nulls, tagged by site."""
    patients = tables.patients(spark, sf_dir)
    wide = prepare_features(S.Resources.of(patients), LIGHT)
    sites = patients.df.select(F.col("ref").alias("pid"), "site")
    return wide.join(sites, "pid")


@query(
    "dataset_write_read",
    with_sql(PAT, LIGHT_SQL) + "select * from light",
)
def dataset_write_read(spark, sf_dir):
    store = DatasetStore(spark, _new_folder(spark))
    if store.dataset("light") is not None:
        raise ValueError("a dataset that was never saved was found")
    store.save_dataset("light", light(spark, sf_dir), partition_by=["site"])
    return store.dataset("light").select("pid", "site", "segment", "age", "balance")


@query(
    "result_document_store",
    with_sql(PAT, LIGHT_SQL)
    + """select site, count(*) as records, count(balance) as balances, max(balance) as highest
    from light group by site""",
)
def result_document_store(spark, sf_dir):
    store = DatasetStore(spark, _new_folder(spark))
    result = light(spark, sf_dir).groupBy("site").agg(
        F.count(F.lit(1)).alias("records"), F.count("balance").alias("balances"), F.max("balance").alias("highest")
    )
    store.save_document("statistics", "light", result)
    return store.document("statistics", "light", "site string, records bigint, balances bigint, highest double")


@query(
    "site_registry_scan",
    """select lower(r_name) as agent_id, r_name as name, 'site/' || r_regionkey as endpoint from region""",
)
def site_registry_scan(spark, sf_dir):
    region = tables.table(spark, sf_dir, "region")
    agents = region.select(
        F.lower("r_name").alias("agent_id"),
        F.col("r_name").alias("name"),
        F.concat(F.lit("site/"), F.col("r_regionkey")).alias("endpoint"),
    )
    # One array in one file, as a registry file is written.
    registry = agents.agg(F.to_json(F.collect_list(F.struct(*agents.columns))).alias("value"))
    path = _new_folder(spark)
    registry.write.text(path)
    return read_sites(spark, path)


@query(
    "feature_schema",
    with_sql(PAT, LIGHT_SQL) + "select pid, segment, age, balance from light",
)
def feature_schema(spark, sf_dir):
    from cohortweave.operators.features import conform

    loose = light(spark, sf_dir).select("balance", F.col("age").cast("int").alias("age"), "segment", "site", "pid")
    return conform(loose, LIGHT)


# --- predicates -------------------------------------------------------------


@query(
    "filter_code_in",
    with_sql(MED) + "select subj as subject, id from med where brand in ('Brand#12', 'Brand#23')",
)
def filter_code_in(spark, sf_dir):
    found = tables.resources(spark, sf_dir).search("/MedicationStatement?code=Brand#12,Brand#23")
    return found.select(F.col("patient").alias("subject"), "id")


@query(
    "filter_code_prefix",
    with_sql(MED) + "select subj as subject, id from med where type like 'S%' or type like 'PRO%'",
)
def filter_code_prefix(spark, sf_dir):
    found = tables.resources(spark, sf_dir).search("/Condition?code:sw=S,PRO")
    return found.select(F.col("patient").alias("subject"), "id")


@query(
    "filter_nested_field",
    with_sql(PAT) + "select pid, country from pat where country in ('NATION_3', 'NATION_17')",
)
def filter_nested_field(spark, sf_dir):
    found = tables.patients(spark, sf_dir).search("/Patient?address-country=NATION_3,NATION_17")
    return found.select(F.col("ref").alias("pid"), F.expr("address[0].country").alias("country"))


@query(
    "filter_date_gt",
    f"select cast(event_id as varchar) as id, 'Patient/' || user_id as subject, {day('ts')} as date "
    "from events where ts > timestamp '2024-01-20 12:00:00'",
)
def filter_date_gt(spark, sf_dir):
    found = tables.observations(spark, sf_dir).search("/Observation?date=gt2024-01-20T12:00:00")
    return found.select("id", F.col("patient").alias("subject"), _text_day("date").alias("date"))


@query(
    "restrict_to_patients",
    with_sql(PAT, OBS, DEATH, EVERY_OBS)
    + "select id, subj as subject from everyobs semi join pat on subj = pid and segment = 'MACHINERY'",
)
def restrict_to_patients(spark, sf_dir):
    resources = tables.resources(spark, sf_dir)
    table = resources["Observation"]
    machinery = resources.search("/Patient?segment=MACHINERY").select(F.col("ref").alias("pid"))
    events = table.search("/Observation")
    return C.restrict_to_patients(table, events, machinery).select("id", F.col("patient").alias("subject"))


@query(
    "restrict_to_encounters",
    with_sql(ENC, MED, OBS, PAT, DEATH, EVERY_OBS)
    + """, chosen as (select * from enc where priority = '1-URGENT' and st > timestamp '2000-12-31')
    select 'Patient' as resource, pid as ref from pat semi join chosen on pid = subj
    union all select 'Encounter', enc from chosen
    union all select 'Observation', id from everyobs semi join chosen on everyobs.subj = chosen.subj
    union all select 'MedicationStatement', id from med semi join chosen on med.enc = chosen.enc""",
)
def restrict_to_encounters(spark, sf_dir):
    resources = tables.resources(spark, sf_dir)
    encounter = resources["Encounter"]
    found = encounter.search("/Encounter?priority=1-URGENT&date=gt2000-12-31")
    chosen = C.encounter_items(encounter, found, tables.as_of()).select(*C.ENCOUNTER_COLUMNS)
    parts = []
    for name, text, existence in (
        ("Patient", "/Patient", False),
        ("Encounter", "/Encounter", False),
        ("Observation", "/Observation", True),
        ("MedicationStatement", "/MedicationStatement", False),
    ):
        table = resources[name]
        kept = C.restrict_to_encounters(table, table.search(text), chosen, existence)
        parts.append(kept.select(F.lit(name).alias("resource"), table.role("ref").alias("ref")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query(
    "satisfy_predicate",
    "select cast(event_id as varchar) as id, value from events where value > 20 and "
    "coalesce(try_cast(json_extract_string(props, '$.k') as integer) < 50, false)",
)
def satisfy_predicate(spark, sf_dir):
    rows = tables.observations(spark, sf_dir).rows
    kept = C.satisfying(rows, "value > 20 and cast(get_json_object(props, '$.k') as int) < 50")
    return kept.select("id", "value")


@query(
    "criterion_aggr",
    with_sql(ENC) + "select subj as pid from enc where ty = 'unplanned' group by subj having count(*) >= 5 and sum(price) > 500000",
)
def criterion_aggr(spark, sf_dir):
    criterion = Criterion("/Encounter?type=unplanned", "aggr:count(1) >= 5 and sum(price) > 500000")
    return C.patients_of_criterion(tables.resources(spark, sf_dir), criterion)


@query(
    "sanitize_names",
    r"""select regexp_replace(trim('{' || p_name || '} (' || p_brand || ') = ' || p_type || '.'),
                    '[\s`*{}\[\]()>#+:~''%^&@<?;,"!$=|.]', '', 'g') as name, count(*) as parts
    from part group by 1""",
)
def sanitize_names(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part")
    raw = F.concat(F.lit("{"), "p_name", F.lit("} ("), "p_brand", F.lit(") = "), "p_type", F.lit("."))
    return part.groupBy(sanitized(raw).alias("name")).agg(F.count(F.lit(1)).alias("parts"))


@query(
    "select_known_columns",
    with_sql(PAT, LIGHT_SQL) + "select pid, age from light",
)
def select_known_columns(spark, sf_dir):
    return known_columns(light(spark, sf_dir), ["pid", "no such item", "age", "nowhere"])


# --- cohorts ----------------------------------------------------------------

CRITERIA = (
    Criterion("/Patient?segment=MACHINERY,BUILDING,FURNITURE", "satisfy:balance > 0"),
    Criterion("/MedicationStatement?code=Brand#12,Brand#23"),
    Criterion("/Condition?code:sw=ECO,PRO", "satisfy:quantity > 30"),
    Criterion("/Condition?code=LARGE"),
    Criterion("/MedicationStatement", "aggr:sum(quantity) > 500"),
)

COHORT_SQL = """base as (select * from pat where segment in ('MACHINERY', 'BUILDING', 'FURNITURE') and balance > 0),
cohort as (
  select pid from base
  intersect select subj from med where brand in ('Brand#12', 'Brand#23')
  intersect select subj from med where (type like 'ECO%' or type like 'PRO%') and qty > 30
  intersect select subj from med where type = 'LARGE'
  intersect select subj from med group by subj having sum(qty) > 500)"""


@query("eligible_patients_base", with_sql(PAT, MED, COHORT_SQL) + "select pid from base")
def eligible_patients_base(spark, sf_dir):
    return C.base_patients(tables.resources(spark, sf_dir), CRITERIA).select("pid")


@query(
    "patients_of_criterion",
    with_sql(PAT, MED, COHORT_SQL)
    + "select distinct subj as pid from med semi join base on subj = pid where (type like 'ECO%' or type like 'PRO%') and qty > 30",
)
def patients_of_criterion(spark, sf_dir):
    resources = tables.resources(spark, sf_dir)
    base = C.base_patients(resources, CRITERIA).select("pid")
    return C.patients_of_criterion(resources, CRITERIA[2]).join(base, "pid", "left_semi")


@query("eligible_patients", with_sql(PAT, MED, COHORT_SQL) + "select pid from cohort")
def eligible_patients(spark, sf_dir):
    return C.eligible_patients(tables.resources(spark, sf_dir), CRITERIA).select("pid")


ENCOUNTER_CRITERIA = (Criterion("/Encounter?type=unplanned"), Criterion("/Encounter?date=gt1997-12-31"))


@query(
    "eligible_encounters",
    with_sql(PAT, MED, ENC, COHORT_SQL)
    + "select enc as encounter, subj as subject from enc semi join cohort on subj = pid "
    "where ty = 'unplanned' and st > timestamp '1997-12-31'",
)
def eligible_encounters(spark, sf_dir):
    resources = tables.resources(spark, sf_dir)
    patients = C.eligible_patients(resources, CRITERIA)
    found = C.eligible_encounters(resources, ENCOUNTER_CRITERIA, patients, tables.as_of())
    return found.select("encounter", "subject")


@query(
    "encounter_items",
    with_sql(ENC)
    + f"""select enc as encounter, subj as subject, {day('st')} as start,
    {day("case when price > 100000 then en else timestamp '2002-01-01' end")} as "end",
    case when price < 400000 then ty end as type from enc""",
)
def encounter_items(spark, sf_dir):
    """Encounters some of which are still open, or of unknown type."""
    table = tables.encounters(spark, sf_dir)
    df = table.df.withColumns(
        {
            "period_end": F.when(F.col("price") > 100000, F.col("period_end")),
            "kind": F.when(F.col("price") < 400000, F.col("kind")),
        }
    )
    items = C.encounter_items(table, df, tables.as_of())
    return items.select("encounter", "subject", _text_day("start").alias("start"), _text_day("end").alias("end"), "type")


@query(
    "encounters_with_readmission",
    with_sql(PAT, ENC)
    + """select distinct c.enc as encounter from enc c join enc p on p.subj = c.subj join pat on pid = c.subj
    where segment = 'MACHINERY' and c.ty = 'unplanned' and p.en < c.st and p.en > c.st - interval '60' day""",
)
def encounters_with_readmission(spark, sf_dir):
    resources = tables.resources(spark, sf_dir)
    patients = C.eligible_patients(resources, [Criterion("/Patient?segment=MACHINERY")])
    criteria = [Criterion("/Encounter", "value:readmission:60")]
    return C.eligible_encounters(resources, criteria, patients, tables.as_of()).select("encounter")


# --- features ---------------------------------------------------------------


def _features(spark, sf_dir, *variables, criteria=()):
    return prepare_features(tables.resources(spark, sf_dir), Featureset(variables), criteria, tables.as_of())


@query(
    "feature_value",
    with_sql(PAT, OBS, DEATH, EVERY_OBS)
    + """select pid, nullif(segment, 'BUILDING') as segment, case when balance >= 0 then balance end as balance,
      case when v.subj is null then 0.0 else v.v end as view,
      case when k.subj is null then 0.0 else k.v end as setting,
      w.code as firstcode
    from pat
    left join (select subj, case when value > 20 then value end as v from
       (select *, row_number() over (partition by subj order by dt, cast(event_id as varchar)) as rn from obs where code = 'view') where rn = 1) v
      on v.subj = pid
    left join (select subj, cast(json_extract_string(props, '$.k') as double) as v from
       (select *, row_number() over (partition by subj order by dt, cast(event_id as varchar)) as rn from obs where code = 'click') where rn = 1) k
      on k.subj = pid
    left join (select subj, code from
       (select *, row_number() over (partition by subj order by dt, id) as rn from everyobs) where rn = 1) w
      on w.subj = pid""",
)
def feature_value(spark, sf_dir):
    return _features(
        spark, sf_dir,
        LIGHT.variables[0],
        LIGHT.variables[2],
        Variable("view", "/Observation?code=view", "value:case when value > 20 then Observation.value end"),
        Variable("setting", "/Observation?code=click", "value:cast(get_json_object(props, '$.k') as double)"),
        Variable("first code", "/Observation", "value:Observation.code", CATEGORICAL),
    )


@query(
    "feature_exists",
    with_sql(PAT, MED, OBS)
    + """select pid, cast(pid in (select subj from med where brand = 'Brand#12') as double) as brandtwelve,
      cast(pid in (select subj from med where type like 'ECO%') as double) as economy,
      cast(pid in (select subj from obs where code = 'error') as double) as errors,
      cast(segment = 'MACHINERY' as double) as machinery from pat""",
)
def feature_exists(spark, sf_dir):
    return _features(
        spark, sf_dir,
        Variable("brand twelve", "/MedicationStatement?code=Brand#12", "value:exists"),
        Variable("economy", "/Condition?code:sw=ECO", "value:exists"),
        Variable("errors", "/Observation?code=error", "value:exists"),
        Variable("machinery", "/Patient?segment=MACHINERY", "value:exists"),
    )


KIND = Variable("kind", "/Encounter", "value:kind", CATEGORICAL)


@query(
    "feature_exists_asof_encounter",
    with_sql(ENC, MED)
    + """select enc.enc as pid, ty as kind, cast(coalesce(f.dt <= en, false) as double) as brandtwelve,
      cast(coalesce(e.dt <= en, false) as double) as economy from enc
    left join (select subj, min(dt) as dt from med where brand = 'Brand#12' group by 1) f on f.subj = enc.subj
    left join (select subj, min(dt) as dt from med where type = 'ECONOMY' group by 1) e on e.subj = enc.subj""",
)
def feature_exists_asof_encounter(spark, sf_dir):
    return _features(
        spark, sf_dir,
        KIND,
        Variable("brand twelve", "/MedicationStatement?code=Brand#12", "value:exists"),
        Variable("economy", "/Condition?code=ECONOMY", "value:exists"),
    )


@query(
    "feature_aggr",
    with_sql(PAT, MED, OBS)
    + """select pid, coalesce(m.n, 0.0) as medications, coalesce(m.q, 0.0) as quantity,
      case when o.subj is null then 0.0 else round(o.a, 6) end as averagevalue,
      case when o.subj is null then 0.0 else o.hi end as highest,
      case when o.subj is null then 0.0 else o.lo end as lowest
    from pat
    left join (select subj, cast(count(*) as double) as n, sum(case when brand = 'Brand#12' then qty end) as q from med group by 1) m on m.subj = pid
    left join (select subj, avg(value) as a, max(value) as hi, min(value) as lo from obs where code = 'purchase' group by 1) o on o.subj = pid""",
)
def feature_aggr(spark, sf_dir):
    purchases = "/Observation?code=purchase"
    wide = _features(
        spark, sf_dir,
        Variable("medications", "/MedicationStatement", "aggr:count"),
        Variable("quantity", "/MedicationStatement?code=Brand#12", "aggr:sum:quantity"),
        Variable("average value", purchases, "aggr:avg:Observation.value"),
        Variable("highest", purchases, "aggr:max:Observation.value"),
        Variable("lowest", purchases, "aggr:min:Observation.value"),
    )
    return wide.withColumn("averagevalue", F.round("averagevalue", 6))


@query(
    "feature_aggr_exists",
    with_sql(PAT, MED)
    + """select pid, cast(pid in (select subj from med group by 1 having count(*) >= 40) as double) as many,
      cast(pid in (select subj from med where brand = 'Brand#12' group by 1 having sum(qty) > 60) as double) as much
    from pat""",
)
def feature_aggr_exists(spark, sf_dir):
    return _features(
        spark, sf_dir,
        Variable("many", "/MedicationStatement", "aggr:exists:count(1) >= 40"),
        Variable("much", "/MedicationStatement?code=Brand#12", "aggr:exists:sum(quantity) > 60"),
    )


@query(
    "broadcast_patient_to_encounters",
    with_sql(PAT, ENC, MED)
    + """select enc.enc as pid, ty as kind, segment, age,
      case when f.enc is null then 0.0 else f.qty end as firstquantity,
      coalesce(n.n, 0.0) as lines, coalesce(p.n, 0.0) as patientlines,
      t.type as firsttype
    from enc join pat on pat.pid = subj
    left join (select enc, qty from (select *, row_number() over (partition by enc order by dt, id) as rn from med where brand like 'Brand#1%') where rn = 1) f on f.enc = enc.enc
    left join (select enc, type from (select *, row_number() over (partition by enc order by dt, id) as rn from med) where rn = 1) t on t.enc = enc.enc
    left join (select enc, cast(count(*) as double) as n from med group by 1) n on n.enc = enc.enc
    left join (select subj, cast(count(*) as double) as n from med group by 1) p on p.subj = enc.subj""",
)
def broadcast_patient_to_encounters(spark, sf_dir):
    return _features(
        spark, sf_dir,
        KIND,
        Variable("segment", "/Patient", "value:segment", CATEGORICAL),
        Variable("age", "/Patient", "value:age"),
        Variable("first quantity", "/MedicationStatement?code:sw=Brand#1", "value:quantity"),
        Variable("first type", "/Condition", "value:code", CATEGORICAL),
        Variable("lines", "/MedicationStatement", "aggr:count", group_by="encounter"),
        Variable("patient lines", "/MedicationStatement", "aggr:count"),
    )


def _encounter_rows(spark, sf_dir):
    table = tables.encounters(spark, sf_dir)
    return C.encounter_items(table, table.rows, tables.as_of()).select(*C.ENCOUNTER_COLUMNS)


READMISSION_2_SQL = """select c.enc as encounter, max(case when c.ty = 'unplanned' and p.en < c.st
    and p.en > c.st - interval '30' day then cast(1 as double) else cast(0 as double) end) as value
    from enc c join enc p on p.subj = c.subj group by 1"""


@query("readmission_type2", with_sql(ENC) + READMISSION_2_SQL)
def readmission_type2(spark, sf_dir):
    return E.readmission(_encounter_rows(spark, sf_dir), 30).select("encounter", "value")


@query(
    "readmission_type1",
    with_sql(ENC)
    + """select c.enc as encounter, max(case when p.ty = 'unplanned' and p.st > c.en
    and p.st < c.en + interval '30' day then cast(1 as double) else cast(0 as double) end) as value
    from enc c join enc p on p.subj = c.subj group by 1""",
)
def readmission_type1(spark, sf_dir):
    return E.readmission(_encounter_rows(spark, sf_dir), 30, kind=1).select("encounter", "value")


@query(
    "hospitalization_count",
    with_sql(ENC)
    + """select c.enc as encounter, cast(sum(case when p.st <> p.en and p.en <= c.st
    and p.st >= c.st - interval '12' month then 1 else 0 end) as double) as value
    from enc c join enc p on p.subj = c.subj group by 1""",
)
def hospitalization_count(spark, sf_dir):
    return E.hospitalization_count(_encounter_rows(spark, sf_dir), 12).select("encounter", "value")


@query(
    "mortality_flag",
    with_sql(PAT, ENC, DEATH)
    + """select pid, coalesce(cast(max(enc.st > death.dt - interval '6' month) as double), cast(0 as double)) as deceased
    from pat left join death on death.subj = pid left join enc on enc.subj = death.subj group by 1""",
)
def mortality_flag(spark, sf_dir):
    return _features(spark, sf_dir, Variable("deceased", "/Observation?code=death", "value:mortality:6"))


@query(
    "first_value_per_key",
    with_sql(PAT, OBS, DEATH, EVERY_OBS)
    + """select pid, case when v.subj is null then 0.0 else v.value end as first
    from pat left join (select subj, value from
       (select *, row_number() over (partition by subj order by dt, id) as rn from everyobs) where rn = 1) v
      on v.subj = pid""",
)
def first_value_per_key(spark, sf_dir):
    text = "/Observation"
    return _features(spark, sf_dir, Variable("first", text, "value:Observation.value"))


WIDE = Featureset(
    (
        Variable("segment", "/Patient", "value:nullif(segment, 'BUILDING')", CATEGORICAL),
        Variable("age", "/Patient", "value:age"),
        Variable("balance", "/Patient", "value:case when balance >= 0 then balance end"),
        Variable("number of medications", "/MedicationStatement", "aggr:count"),
        Variable("brand #12", "/MedicationStatement?code=Brand#12", "value:exists"),
        Variable("economy", "/Condition?code:sw=ECO", "value:exists"),
        Variable("purchase", "/Observation?code=purchase", "value:Observation.value"),
        Variable("deceased", "/Observation?code=death", "value:mortality:6", role=DEPENDENT),
    )
)

WIDE_SQL = """wide as (
  select pid, nullif(segment, 'BUILDING') as segment, age, case when balance >= 0 then balance end as balance,
    coalesce(m.n, 0.0) as numberofmedications, coalesce(m.b, 0.0) as brand12, coalesce(m.e, 0.0) as economy,
    case when o.subj is null then 0.0 else o.value end as purchase, coalesce(d.v, 0.0) as deceased
  from pat
  left join (select subj, cast(count(*) as double) as n, cast(max(brand = 'Brand#12') as double) as b,
                    cast(max(type like 'ECO%') as double) as e from med group by 1) m on m.subj = pid
  left join (select subj, value from
       (select *, row_number() over (partition by subj order by dt, cast(event_id as varchar)) as rn from obs where code = 'purchase')
     where rn = 1) o on o.subj = pid
  left join (select death.subj, cast(max(enc.st > death.dt - interval '6' month) as double) as v
             from death join enc on enc.subj = death.subj group by 1) d on d.subj = pid)"""


@query("assemble_feature_table", with_sql(PAT, ENC, MED, OBS, DEATH, WIDE_SQL) + "select * from wide")
def assemble_feature_table(spark, sf_dir):
    return prepare_features(tables.resources(spark, sf_dir), WIDE)


TIMED = Featureset(
    (
        Variable("readmission", "/Encounter", "value:readmission:2:30"),
        Variable("unplanned after", "/Encounter?type=unplanned", "value:readmission:1:45"),
        Variable("stays", "/Encounter", "value:hospitalization:12"),
        Variable("price", "/Encounter", "value:price"),
    )
)


@query(
    "grain_selection",
    with_sql(PAT, ENC)
    + """select 'patient' as grain, pid, segment, cast(null as double) as readmission from pat
    union all select 'encounter', enc, segment, value from enc join pat on pid = subj
    join ("""
    + READMISSION_2_SQL
    + ") on encounter = enc",
)
def grain_selection(spark, sf_dir):
    segment = Variable("segment", "/Patient", "value:segment", CATEGORICAL)
    by_patient = _features(spark, sf_dir, segment)
    by_encounter = _features(spark, sf_dir, segment, TIMED.variables[0])
    patient_rows = by_patient.withColumns({"grain": F.lit("patient"), "readmission": F.lit(None).cast("double")})
    return patient_rows.unionByName(by_encounter.withColumn("grain", F.lit("encounter")))


@query(
    "age_in_years",
    with_sql(ENC) + "select enc as ref, cast(date_sub('year', st, timestamp '2002-01-01') as double) as years from enc",
)
def age_in_years_query(spark, sf_dir):
    rows = tables.encounters(spark, sf_dir).rows
    return rows.select("ref", age_in_years(F.col("period_start"), tables.as_of()).alias("years"))


PREPARE_CRITERIA = (
    Criterion("/Patient", "satisfy:balance > -500"),
    Criterion("/MedicationStatement?code=Brand#12,Brand#23,Brand#4"),
    Criterion("/Condition", "aggr:count(1) >= 10"),
)

PREPARE_COHORT_SQL = """chosen as (
  select pid from pat where balance > -500
  intersect select subj from med where brand in ('Brand#12', 'Brand#23', 'Brand#4')
  intersect select subj from med group by subj having count(*) >= 10)"""


def prepared(spark, sf_dir):
    store = DatasetStore(spark, _new_folder(spark))
    return prepare_dataset(
        spark, tables.resources(spark, sf_dir), WIDE, PREPARE_CRITERIA, store, "wide", tables.as_of()
    )


@query(
    "prepare_dataset",
    with_sql(PAT, ENC, MED, OBS, DEATH, WIDE_SQL, PREPARE_COHORT_SQL)
    + "select wide.* from wide semi join chosen on wide.pid = chosen.pid",
)
def prepare_dataset_query(spark, sf_dir):
    return prepared(spark, sf_dir).dataset


@query(
    "prepare_dataset_encounters",
    with_sql(PAT, ENC)
    + """, kept as (select enc.* from enc join pat on pid = subj where segment = 'MACHINERY' and priority <> '5-LOW')
    select c.enc as pid,
      max(case when c.ty = 'unplanned' and p.en < c.st and p.en > c.st - interval '30' day
          then cast(1 as double) else cast(0 as double) end) as readmission,
      max(case when c.ty = 'unplanned' and p.ty = 'unplanned' and p.st > c.en and p.st < c.en + interval '45' day
          then cast(1 as double) else cast(0 as double) end) as unplannedafter,
      cast(sum(case when p.st <> p.en and p.en <= c.st and p.st >= c.st - interval '12' month then 1 else 0 end)
          as double) as stays,
      max(c.price) as price
    from kept c join kept p on p.subj = c.subj group by 1""",
)
def prepare_dataset_encounters(spark, sf_dir):
    """Encounter grain: every temporal feature is computed among the eligible encounters."""
    criteria = (
        Criterion("/Patient?segment=MACHINERY"),
        Criterion("/Encounter?priority=1-URGENT,2-HIGH,3-MEDIUM,4-NOT SPECIFIED"),
    )
    return prepare_features(tables.resources(spark, sf_dir), TIMED, criteria, tables.as_of())
