"""The driver's tables in clinical roles, once as resource tables and once as SQL.

========================  ====================================================
Patient                   customer; the site is the region of its nation
Encounter                 orders; as many days long as it has lineitems, less one;
                          unplanned if urgent or of high priority
MedicationStatement       lineitem with the brand of its part as code
Condition                 lineitem with the type of its part as code
Observation               events with their type as code, and one ``death`` per
                          customer at the last returned shipment
========================  ====================================================
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortweave.sources.resources import DATE, REFERENCE, Resources, ResourceTable, SearchParameter

AS_OF_TEXT = "2002-01-01 00:00:00"
UNPLANNED_PRIORITIES = ("1-URGENT", "2-HIGH")


def as_of():
    return F.lit(AS_OF_TEXT).cast("timestamp_ntz")


@lru_cache(maxsize=None)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver; its file's schema is looked up once per session."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column: str):
    return F.col(column).cast("string")


def patients(spark: SparkSession, sf_dir: str) -> ResourceTable:
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    df = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            _text("c_custkey").alias("id"),
            F.concat(F.lit("Patient/"), _text("c_custkey")).alias("ref"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_acctbal").alias("balance"),
            F.floor(F.abs("c_acctbal") / 100).cast("double").alias("age"),
            F.col("r_name").alias("site"),
            F.array(F.struct(F.col("n_name").alias("country"))).alias("address"),
            F.array(F.struct(F.lit("name").alias("system"), F.col("c_name").alias("value"))).alias("identifier"),
        )
    )
    return ResourceTable(
        "Patient", df, ref="ref", subject="ref",
        parameters={
            "_id": SearchParameter("id", REFERENCE),
            "segment": SearchParameter("segment"),
            "site": SearchParameter("site"),
            "address-country": SearchParameter("address.country"),
            "identifier": SearchParameter("identifier.value"),
        },
    )


def encounters(spark: SparkSession, sf_dir: str) -> ResourceTable:
    orders, lineitem = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    lines = lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n_lines"))
    unplanned = F.col("o_orderpriority").isin(*UNPLANNED_PRIORITIES)
    df = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        _text("o_orderkey").alias("id"),
        F.concat(F.lit("Encounter/"), _text("o_orderkey")).alias("ref"),
        F.concat(F.lit("Patient/"), _text("o_custkey")).alias("patient"),
        F.col("o_orderdate").alias("period_start"),
        F.expr("o_orderdate + make_dt_interval(coalesce(n_lines, 1) - 1)").alias("period_end"),
        F.when(unplanned, "unplanned").otherwise("planned").alias("kind"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("price"),
    )
    return ResourceTable(
        "Encounter", df, ref="ref", subject="patient", encounter="ref",
        date="period_start", start="period_start", end="period_end", type="kind",
        parameters={
            "_id": SearchParameter("id", REFERENCE),
            "subject": SearchParameter("patient", REFERENCE),
            "type": SearchParameter("kind"),
            "priority": SearchParameter("priority"),
            "date": SearchParameter("period_start", DATE),
        },
    )


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the brand and type of their part and the patient of their order, as the tables hold them."""
    lineitem, orders, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    # Parts first, so that the lines of an order leave the last join side by side.
    return (
        lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_custkey", "p_brand", "p_type", "l_shipdate", "l_quantity")
    )


def statement_columns(column: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """What a statement tells besides its code, from a line of :func:`statement_lines`."""
    return {
        "id": F.concat_ws("-", *[column(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]),
        "patient": F.concat(F.lit("Patient/"), column("o_custkey").cast("string")),
        "context": F.concat(F.lit("Encounter/"), column("l_orderkey").cast("string")),
        "date": column("l_shipdate"),
        "quantity": column("l_quantity"),
    }


def _statements(spark: SparkSession, sf_dir: str, name: str, code: str) -> ResourceTable:
    told = {name: c.alias(name) for name, c in statement_columns().items()}
    df = statement_lines(spark, sf_dir).select(
        told["id"], told["patient"], told["context"], F.col(code).alias("code"), told["date"], told["quantity"]
    )
    return ResourceTable(
        name, df, ref="id", subject="patient", encounter="context", date="date",
        parameters={
            "subject": SearchParameter("patient", REFERENCE),
            "context": SearchParameter("context", REFERENCE),
            "code": SearchParameter("code"),
            "date": SearchParameter("date", DATE),
        },
    )


def observations(spark: SparkSession, sf_dir: str) -> ResourceTable:
    events, lineitem, orders = (table(spark, sf_dir, t) for t in ("events", "lineitem", "orders"))
    measured = events.select(
        _text("event_id").alias("id"),
        F.concat(F.lit("Patient/"), _text("user_id")).alias("patient"),
        F.col("event_type").alias("code"),
        F.col("value"),
        F.col("ts").alias("date"),
        F.col("props"),
    )
    deaths = (
        lineitem.filter("l_returnflag = 'R'")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey")
        .agg(F.max("l_shipdate").alias("date"))
        .select(
            F.concat(F.lit("death-"), _text("o_custkey")).alias("id"),
            F.concat(F.lit("Patient/"), _text("o_custkey")).alias("patient"),
            F.lit("death").alias("code"),
            F.lit(None).cast("double").alias("value"),
            F.col("date"),
            F.lit(None).cast("string").alias("props"),
        )
    )
    return ResourceTable(
        "Observation", measured.unionByName(deaths), ref="id", subject="patient", date="date",
        parameters={
            "subject": SearchParameter("patient", REFERENCE),
            "code": SearchParameter("code"),
            "date": SearchParameter("date", DATE),
        },
    )


class ClinicalResources(Resources):
    """The five resource tables, each built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self._build = {
            "Patient": lambda: patients(spark, sf_dir),
            "Encounter": lambda: encounters(spark, sf_dir),
            "MedicationStatement": lambda: _statements(spark, sf_dir, "MedicationStatement", "p_brand"),
            "Condition": lambda: _statements(spark, sf_dir, "Condition", "p_type"),
            "Observation": lambda: observations(spark, sf_dir),
        }

    def __missing__(self, name: str) -> ResourceTable:
        self[name] = self._build[name]()
        return self[name]


def resources(spark: SparkSession, sf_dir: str) -> Resources:
    return ClinicalResources(spark, sf_dir)


# The same relations for the checking SQL, to be put behind WITH.
PAT = """pat as (
  select 'Patient/' || c_custkey as pid, c_mktsegment as segment, c_acctbal as balance,
         cast(floor(abs(c_acctbal) / 100) as double) as age, r_name as site, n_name as country,
         c_name as name
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""

ENC = """enc as (
  select 'Encounter/' || o_orderkey as enc, 'Patient/' || o_custkey as subj, o_orderdate as st,
         o_orderdate + interval '1' day * (coalesce(c, 1) - 1) as en,
         case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'unplanned' else 'planned' end as ty,
         o_orderpriority as priority, o_totalprice as price
  from orders left join (select l_orderkey, cast(count(*) as int) as c from lineitem group by 1)
    on l_orderkey = o_orderkey)"""

MED = """med as (
  select 'Patient/' || o_custkey as subj, 'Encounter/' || l_orderkey as enc, p_brand as brand, p_type as type,
         l_shipdate as dt, l_quantity as qty,
         l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as id
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)"""

OBS = """obs as (
  select 'Patient/' || user_id as subj, event_type as code, value, ts as dt, props, event_id from events)"""

DEATH = """death as (
  select 'Patient/' || o_custkey as subj, max(l_shipdate) as dt
  from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'R' group by 1)"""


# Every observation, deaths included.
EVERY_OBS = """everyobs as (
  select subj, code, value, dt, cast(event_id as varchar) as id from obs
  union all select subj, 'death', null, dt, 'death-' || substr(subj, 9) from death)"""


def with_sql(*parts: str) -> str:
    return "with " + ",\n".join(parts) + "\n"


def day(column: str) -> str:
    """A date as text, in both engines."""
    return f"strftime({column}, '%Y-%m-%d')"
