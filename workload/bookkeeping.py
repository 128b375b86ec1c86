"""States of datasets and models, from site-tagged tables that Spark derives.

A run is a market segment with an order status and a price class, a site is a nation, an
algorithm is an order priority: this gives every table its full variety of states, duplicates and
gaps. Every order is a result of a run that has sources.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortweave.operators import federation as J
from workload.registry import query
from workload.tables import table, with_sql


def _run_id():
    return F.concat_ws(" ", "c_mktsegment", "o_orderstatus", F.floor(F.col("o_totalprice") / 100000).cast("string"))


def _orders(spark, sf_dir):
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )


def _sources(spark, sf_dir):
    """``(model_id, site, records, state, selection, error_message)``, one row per run and site of its segment.

    Every order belongs to one of these runs; a site may have no order of a run.
    """
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    runs = _orders(spark, sf_dir).select("c_mktsegment", _run_id().alias("model_id")).distinct()
    grouped = (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("c_mktsegment", F.col("n_name").alias("site"))
        .agg(F.max("c_acctbal").alias("high"), F.min("c_acctbal").alias("low"), F.count(F.lit(1)).alias("records"))
        .join(runs, "c_mktsegment")
    )
    state = F.when(F.col("low") > 1500, "error").when(F.col("high") > 9000, "final").otherwise("executing")
    selection = F.when(F.col("high") > 9700, "selected").when(F.col("high") > 9300, "discarded")
    message = F.when(state == "error", F.concat("site", F.lit(": lowest value is "), F.floor("low").cast("string")))
    return grouped.select(
        "model_id", "site", "records", state.alias("state"), selection.alias("selection"), message.alias("error_message")
    )


RUN_SQL = "c_mktsegment || ' ' || o_orderstatus || ' ' || cast(floor(o_totalprice / 100000) as bigint)"

SOURCES = f"""sources as (
  select model_id, site, records,
    case when low > 1500 then 'error' when high > 9000 then 'final' else 'executing' end as state,
    case when high > 9700 then 'selected' when high > 9300 then 'discarded' end as selection,
    case when low > 1500 then site || ': lowest value is ' || cast(floor(low) as integer) end as error_message
  from (select c_mktsegment as segment, n_name as site, count(*) as records, max(c_acctbal) as high, min(c_acctbal) as low
        from customer join nation on c_nationkey = n_nationkey group by 1, 2)
  join (select distinct c_mktsegment as segment, {RUN_SQL} as model_id
        from orders join customer on o_custkey = c_custkey) using (segment))"""


def _results(spark, sf_dir):
    """``(model_id, algorithm, site)``: results that have come from a site, repeats included. Every order is one."""
    return _orders(spark, sf_dir).select(
        _run_id().alias("model_id"),
        F.col("o_orderpriority").alias("algorithm"),
        F.col("n_name").alias("site"),
        F.col("o_orderkey").alias("result_id"),
        F.floor("o_totalprice").alias("price"),
    )


RESULTS = f"""results as (
  select {RUN_SQL} as model_id, o_orderpriority as algorithm, n_name as site, o_orderkey as result_id,
    cast(floor(o_totalprice) as bigint) as price
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""


@query(
    "dataset_state_rollup",
    with_sql(SOURCES, RESULTS)
    + """, everything as (select model_id as dataset_id, state, selection from sources
      union all select 'finished ' || model_id, 'final', null from sources
      union all select 'chosen ' || model_id, 'final', selection from sources
      union all select 'open ' || model_id, case when state = 'error' then 'final' else state end, null from sources)
    select dataset_id, case when bool_or(state = 'error') then 'error'
      when bool_or(coalesce(selection, '') = 'selected') then 'final'
      when bool_and(state = 'final') then 'ready' else 'executing' end as state from everything group by 1""",
)
def dataset_state_rollup(spark, sf_dir):
    sources = _sources(spark, sf_dir)
    none = F.lit(None).cast("string")
    calm = F.when(F.col("state") == "error", "final").otherwise(F.col("state"))
    variants = (
        ("", F.col("state"), F.col("selection")),
        ("finished ", F.lit("final"), none),
        ("chosen ", F.lit("final"), F.col("selection")),
        ("open ", calm, none),
    )
    entries = F.array(
        *[
            F.struct(
                F.concat(F.lit(prefix), "model_id").alias("dataset_id"),
                state.alias("state"),
                selection.alias("selection"),
            )
            for prefix, state, selection in variants
        ]
    )
    return J.dataset_state(sources.select(F.inline(entries)))


@query(
    "merge_source_results",
    with_sql(SOURCES, RESULTS)
    + """, newer as (select model_id, site, count(*) as n from results group by 1, 2)
    select sources.model_id, sources.site, case when n is null then records else n end as records,
      case when n is null then state when n > 3 then 'final' else 'error' end as state,
      case when n is null then selection end as selection,
      case when n is null then error_message when n > 3 then null else 'few' end as error_message
    from sources left join newer using (model_id, site)""",
)
def merge_source_results(spark, sf_dir):
    arrived = _results(spark, sf_dir)
    newer = arrived.groupBy("model_id", "site").agg(F.count(F.lit(1)).alias("records"))
    many = F.col("records") > 3
    results = newer.select(
        "model_id",
        "site",
        "records",
        F.when(many, "final").otherwise("error").alias("state"),
        F.lit(None).cast("string").alias("selection"),
        F.when(~many, "few").alias("error_message"),
    )
    return J.merge_source_results(_sources(spark, sf_dir), results, ["model_id", "site"])


@query("selected_sites", with_sql(SOURCES) + "select model_id, site from sources where selection = 'selected'")
def selected_sites(spark, sf_dir):
    return J.selected_sites(_sources(spark, sf_dir)).select("model_id", "site")


@query(
    "waiting_sites",
    with_sql(SOURCES, RESULTS)
    + """select 'training' as step, model_id, site from sources where selection = 'selected'
      and (model_id, site) not in (select (model_id, site) from results where algorithm = '1-URGENT')
    union all select 'testing', model_id, site from sources where selection = 'selected'
      and (model_id, site) not in (select (model_id, site) from results where algorithm = '5-LOW')""",
)
def waiting_sites(spark, sf_dir):
    selected = J.selected_sites(_sources(spark, sf_dir)).select("model_id", "site")
    results = _results(spark, sf_dir)

    def waiting(step: str, algorithm: str):
        received = results.filter(F.col("algorithm") == algorithm)
        return J.waiting_sites(selected, received, ["model_id", "site"]).select(F.lit(step).alias("step"), "*")

    return waiting("training", "1-URGENT").unionByName(waiting("testing", "5-LOW"))


@query(
    "validation_pairs",
    with_sql(SOURCES, RESULTS)
    + """, models as (select distinct model_id, algorithm, site as model_site from results)
    select model_id, site, algorithm, model_site from sources join models using (model_id)
    where selection = 'selected' and site <> model_site""",
)
def validation_pairs(spark, sf_dir):
    sites = J.selected_sites(_sources(spark, sf_dir)).select("model_id", "site")
    models = _results(spark, sf_dir).select("model_id", "algorithm", F.col("site").alias("model_site")).distinct()
    return J.validation_pairs(sites, models).select("model_id", "site", "algorithm", "model_site")


@query(
    "integrity_checks",
    with_sql(SOURCES, RESULTS)
    + """, supplied as (
      select model_id, algorithm, site as model_site, n_name as site from results
      join lineitem on l_orderkey = result_id join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
    present as (select distinct model_id, algorithm, site as model_site from results),
    requested as (select model_id || ' at ' || site as model_id, algorithm from results)
    select model_id, 'duplicate algorithm' as "check", algorithm as detail from requested group by 1, 3 having count(*) > 1
    union all
    select model_id, 'site missing from ensemble', algorithm || '/' || model_site from
      (select a.model_id, a.algorithm, s.model_site from (select distinct model_id, algorithm from present) a
       join (select distinct model_id, model_site from present) s on a.model_id = s.model_id
       except select model_id, algorithm, model_site from present)
    union all
    select model_id, 'duplicate statistics', algorithm || '/' || model_site || '/' || site from supplied
      group by model_id, algorithm, model_site, site having count(*) > 1
    union all
    select model_id, 'validated at its own site', algorithm || '/' || model_site from supplied where site = model_site""",
)
def integrity_checks(spark, sf_dir):
    results = _results(spark, sf_dir)
    lineitem, supplier, nation = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    statistics = (
        results.withColumnRenamed("site", "model_site")
        .join(lineitem, F.col("l_orderkey") == F.col("result_id"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select("model_id", "algorithm", "model_site", F.col("n_name").alias("site"))
    )
    requested = results.select(F.concat_ws(" at ", "model_id", "site").alias("model_id"), "algorithm")
    return J.integrity_violations(requested, results.withColumnRenamed("site", "model_site"), statistics)


@query(
    "error_rollup",
    with_sql(SOURCES)
    + """select model_id, 'error' as state, string_agg(error_message, chr(10) order by error_message) as error_message
    from sources where error_message is not null group by 1""",
)
def error_rollup(spark, sf_dir):
    return J.error_rollup(_sources(spark, sf_dir))


@query(
    "model_state_rollup",
    with_sql(SOURCES, RESULTS)
    + """, picked as (select model_id, site from sources where selection = 'selected'),
    progress as (
      select r.algorithm || ' ' || model_id as model_id, (select count(*) from picked p where p.model_id = r.model_id) as selected,
        count(distinct case when s.site is not null then r.site end) as trained,
        count(distinct case when s.site is not null and price % 10 > 2 then r.site end) as validated,
        count(distinct case when s.site is not null and price % 10 > 5 then r.site end) as tested,
        count(*) filter (r.site = 'NATION_3' and price % 100 = 7) as errors,
        count(*) filter (r.site = 'NATION_17' and price % 100 = 3) as chosen
      from results r left join picked s using (model_id, site) group by r.algorithm, model_id)
    select model_id, selected, trained, validated, tested, errors, chosen, case when errors > 0 then 'error'
      when chosen > 0 then 'final' when trained < selected then 'training'
      when selected > 1 and validated < selected then 'validating' when tested < selected then 'testing'
      else 'ready' end as state from progress""",
)
def model_state_rollup(spark, sf_dir):
    picked = J.selected_sites(_sources(spark, sf_dir)).select("model_id", "site")
    selected = picked.groupBy("model_id").agg(F.count(F.lit(1)).alias("selected"))
    arrived = _results(spark, sf_dir).join(picked.withColumn("picked", F.lit(True)), ["model_id", "site"], "left")

    def sites(condition):
        return F.count_distinct(F.when(F.col("picked") & condition, F.col("site")))

    def at(site: str, last: int):
        return F.count(F.when((F.col("site") == site) & (F.col("price") % 100 == last), F.lit(1)))

    progress = (
        arrived.groupBy("algorithm", "model_id")
        .agg(
            sites(F.lit(True)).alias("trained"),
            sites(F.col("price") % 10 > 2).alias("validated"),
            sites(F.col("price") % 10 > 5).alias("tested"),
            at("NATION_3", 7).alias("errors"),
            at("NATION_17", 3).alias("chosen"),
        )
        .join(selected, "model_id", "left")
        .withColumn("selected", F.coalesce("selected", F.lit(0)).cast("long"))
        .withColumn("model_id", F.concat_ws(" ", "algorithm", "model_id"))
        .drop("algorithm")
    )
    return J.model_state(progress)
