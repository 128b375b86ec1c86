"""Statistics of prepared datasets and their encodings."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import PySparkException
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.functions.expressions import in_training_split
from cohortweave.operators import dictionary, encode, profile, sketches
from cohortweave.operators.training import LOGISTIC_REGRESSION, Algorithm, feature_stages
from cohortweave.session import materialize
from cohortweave.spec import CATEGORICAL, Featureset, Variable
from workload import tables
from workload.extraction import LIGHT_SQL, PREPARE_COHORT_SQL, WIDE_SQL, light, prepared
from workload.registry import query
from workload.tables import DEATH, ENC, MED, OBS, PAT, with_sql

LIGHT_WITH = with_sql(PAT, LIGHT_SQL)


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- statistics -------------------------------------------------------------


@query("stat_count", LIGHT_WITH + "select site, count(*) as records from light group by site")
def stat_count(spark, sf_dir):
    return profile.summary(light(spark, sf_dir), ["age"], by=["site"]).select("site", "records")


@query(
    "stat_min_max",
    LIGHT_WITH
    + """select site, 'age' as variable, min(age) as min, max(age) as max from light group by site
    union all select site, 'balance', min(balance), max(balance) from light group by site""",
)
def stat_min_max(spark, sf_dir):
    numbers = profile.summary(light(spark, sf_dir), ["age", "balance"], by=["site"])
    return numbers.select("site", "variable", "min", "max")


@query(
    "stat_null_percentage",
    LIGHT_WITH
    + """select 'segment' as variable, count(*) - count(segment) as nulls,
        round(cast(count(*) - count(segment) as double) / count(*) * 100, 6) as null_percentage from light
    union all select 'balance', count(*) - count(balance), round(cast(count(*) - count(balance) as double) / count(*) * 100, 6) from light
    union all select 'age', count(*) - count(age), round(cast(count(*) - count(age) as double) / count(*) * 100, 6) from light""",
)
def stat_null_percentage(spark, sf_dir):
    numbers = profile.summary(light(spark, sf_dir).drop("site"))
    return _rounded(numbers.select("variable", "nulls", "null_percentage"), "null_percentage")


@query(
    "stat_mean",
    LIGHT_WITH
    + """select site, 'age' as variable, round(avg(age), 6) as mean from light group by site
    union all select site, 'balance', round(avg(balance), 6) from light group by site""",
)
def stat_mean(spark, sf_dir):
    numbers = profile.summary(light(spark, sf_dir), ["age", "balance"], by=["site"])
    return _rounded(numbers.select("site", "variable", "mean"), "mean")


@query(
    "stat_distribution_categorical",
    LIGHT_WITH
    + """select 'segment' as variable, segment as value, count(*) as count,
      round(cast(count(*) as double) / (select count(*) from light) * 100, 6) as percentage from light group by segment""",
)
def stat_distribution_categorical(spark, sf_dir):
    return _rounded(profile.distribution(light(spark, sf_dir).drop("site"), ["segment"]), "percentage")


@query(
    "stat_distribution_numeric",
    LIGHT_WITH
    + """, long as (select site, 'age' as variable, age as value from light union all select site, 'balance', balance from light)
    select site, variable, round(value, 2) as value, count(*) as count,
      round(cast(count(*) as double) / max(n) * 100, 6) as percentage
    from long join (select site, count(*) as n from light group by 1) using (site) group by 1, 2, 3""",
)
def stat_distribution_numeric(spark, sf_dir):
    values = profile.distribution(light(spark, sf_dir), ["age", "balance"], by=["site"])
    return _rounded(values, "percentage").withColumn("value", F.round(F.col("value").cast("double"), 2))


def _top_sql(by: str, group: str) -> str:
    """Top four values per variable of ``long(variable, value)`` and the rest as Others."""
    return f""", counted as (select {by} variable, value, count(*) as n from long group by {group} variable, value),
    sized as (select {by} variable, sum(n) as records from counted group by {group} variable),
    ranked as (select *, row_number() over (partition by {by} variable order by n desc, value asc nulls last) as rn,
                      count(*) over (partition by {by} variable) as k from counted),
    labelled as (select {by} variable, case when k > 4 and rn > 4 then 'Others' else value end as value,
                        least(rn, 5) as rank, n from ranked),
    topped as (select {by} variable, cast(rank as integer) as rank, value, cast(sum(n) as bigint) as count
               from labelled group by {group} variable, rank, value)"""


@query(
    "stat_topk_others",
    with_sql(
        """long as (select 'code' as variable, event_type as value from events
        union all select 'priority', o_orderpriority from orders
        union all select 'status', o_orderstatus from orders)"""
    )
    + _top_sql("", "")
    + """select variable, rank, value, count, round(cast(count as double) / records * 100, 6) as percentage
    from topped join sized using (variable)""",
)
def stat_topk_others(spark, sf_dir):
    """Of two tables: one code per event, two per order."""
    events = tables.table(spark, sf_dir, "events").select(F.col("event_type").alias("code"))
    orders = tables.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")
    )
    top = profile.top_values(events).unionByName(profile.top_values(orders))
    return _rounded(top, "percentage")


PROFILED = ("segment", "age", "balance", "numberofmedications", "brand12", "economy", "purchase", "deceased")
PROFILE_LONG = "long as (" + " union all ".join(
    f"select '{v}' as variable, cast({v} as varchar) as value from wide semi join chosen on wide.pid = chosen.pid"
    for v in PROFILED
) + ")"


@query(
    "profile_dataset",
    with_sql(PAT, ENC, MED, OBS, DEATH, WIDE_SQL, PREPARE_COHORT_SQL, PROFILE_LONG)
    + _top_sql("", "")
    + """, numbers as (
      select variable, case when variable = 'segment' then 'categorical' else 'numeric' end as data_type,
        count(*) as records, count(*) - count(value) as nulls,
        min(case when variable <> 'segment' then cast(value as double) end) as min,
        max(case when variable <> 'segment' then cast(value as double) end) as max,
        round(avg(case when variable <> 'segment' then cast(value as double) end), 6) as mean
      from long group by variable)
    select numbers.*, round(cast(nulls as double) / records * 100, 6) as null_percentage, values as value_distribution
    from numbers join (select variable, string_agg(coalesce(value, 'null') || '=' || count, '|' order by rank) as values
                       from topped group by variable) using (variable)""",
)
def profile_dataset(spark, sf_dir):
    """The stored statistics of the prepared dataset, its distributions as text."""
    statistics = prepared(spark, sf_dir).statistics
    text = F.transform(
        "value_distribution",
        lambda r: F.concat(F.coalesce(r["value"], F.lit("null")), F.lit("="), r["count"].cast("string")),
    )
    return _rounded(
        statistics.withColumn("value_distribution", F.concat_ws("|", text)), "mean", "null_percentage"
    )


# --- items ------------------------------------------------------------------

BANDS_SQL = "case when age < 10 then '0-10'" + "".join(
    f" when age < {low + 10} then '{low}-{low + 10}'" for low in range(10, 80, 10)
) + " when age < 1000 then '80+' end"

ITEMS_SQL = f"""items as (
  select site, pid, 'segment_' || segment as item from light where segment is not null
  union all select site, pid, 'age_' || {BANDS_SQL} from light
  union all select site, pid, 'balance' from light where balance <> 0)"""


@query(
    "onehot_wide",
    LIGHT_WITH
    + "select pid, site, age, balance, "
    + ", ".join(
        f"cast(coalesce(segment = '{s}', false) as double) as \"segment_{s}\""
        for s in ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + " from light",
)
def onehot_wide(spark, sf_dir):
    return encode.onehot_wide(light(spark, sf_dir), ["segment"])


def _band_columns(source: str) -> str:
    names = [f"{low}-{low + 10}" for low in range(0, 80, 10)] + ["80+"]
    return ", ".join(f"cast(coalesce({source} = '{n}', false) as double) as \"age_{n}\"" for n in names)


@query(
    "age_bands",
    LIGHT_WITH + f"select pid, {_band_columns('band')} from (select *, {BANDS_SQL} as band from light)",
)
def age_bands(spark, sf_dir):
    return encode.age_bands(light(spark, sf_dir).select("pid", "age"))


@query(
    "categorical_transform",
    LIGHT_WITH
    + f"select pid, site, balance, {_band_columns('band')}, "
    + ", ".join(
        f"cast(coalesce(segment = '{s}', false) as double) as \"segment_{s}\""
        for s in ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + f" from (select *, {BANDS_SQL} as band from light)",
)
def categorical_transform(spark, sf_dir):
    return encode.categorical_transform(light(spark, sf_dir), exclude=("pid", "site"))


@query(
    "items_array",
    with_sql(PAT, LIGHT_SQL, ITEMS_SQL)
    + "select site, pid, string_agg(item, '|' order by item) as items from items group by 1, 2",
)
def items_array(spark, sf_dir):
    rows = encode.items_array(light(spark, sf_dir), keep=("site", "pid"))
    return rows.withColumn("items", F.concat_ws("|", "items"))


@query("items_long", with_sql(PAT, LIGHT_SQL, ITEMS_SQL) + "select site, pid, item from items")
def items_long(spark, sf_dir):
    return encode.items_long(light(spark, sf_dir), keep=("site", "pid"))


# --- sketches ---------------------------------------------------------------

QUANTILES = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


@query(
    "federated_quantiles",
    with_sql(PAT, MED)
    + f"""select v.variable, p.p as probability, cast(n as bigint) as "values", true as within,
      case when p.p = 0 then least when p.p = 1 then most end as exact_end
    from (select 'balance' as variable, count(balance) as n, min(balance) as least, max(balance) as most from pat
          union all select 'quantity', count(qty), min(qty), max(qty) from med) v,
      (values {", ".join(f"(cast({p} as double))" for p in QUANTILES)}) p(p)""",
)
def federated_quantiles(spark, sf_dir):
    """Quantiles over all sites from the sites' sketches; their ranks among all values are counted exactly.

    ``within``: the share asked for lies between the shares of smaller and of not larger values, up to the
    error that the sketch allows. The lowest and highest value are exact.
    """
    resources = tables.resources(spark, sf_dir)
    sites = resources["Patient"].df.select(F.col("ref").alias("patient"), "site")
    measures = {
        "balance": resources["Patient"].df.select("site", F.col("balance").alias("value")),
        "quantity": resources["MedicationStatement"].df.join(sites, "patient").select("site", F.col("quantity").alias("value")),
    }
    long = reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("variable"), "*") for n, df in measures.items()])
    per_site = reduce(
        DataFrame.unionByName,
        [sketches.quantile_sketches(df.withColumnRenamed("value", n), [n], ["site"]) for n, df in measures.items()],
    )
    found = materialize(sketches.quantiles(sketches.merged_sketches(per_site), QUANTILES))
    # A few quantiles of a variable as one row, so that every value meets it once.
    asked = found.groupBy("variable").agg(F.collect_list(F.struct("probability", "quantile", "values")).alias("q"))
    met = long.join(F.broadcast(asked), "variable").select("variable", "value", F.explode("q").alias("q"))
    ranks = met.groupBy("variable", "q.probability", "q.quantile", "q.values").agg(
        F.count_if(F.col("value") < F.col("q.quantile")).alias("below"), F.count_if(F.col("value") <= F.col("q.quantile")).alias("upto")
    )
    p, n, error = F.col("probability"), F.col("values"), F.lit(sketches.RANK_ERROR)
    return ranks.select(
        "variable", "probability", "values",
        ((F.col("below") / n - error <= p) & (p <= F.col("upto") / n + error)).alias("within"),
        F.when(p.isin(0.0, 1.0), F.col("quantile")).alias("exact_end"),
    )


# --- dictionaries of categories ---------------------------------------------

# Statements of medication by brand, patient and day; the patients grow with the data.
CATEGORIES = ("code", "patient", "date")
CATEGORIES_SQL = """cat as (
  select id, brand as code, subj as patient, strftime(dt, '%Y-%m-%d') as date from med
), entries as (
  select 'code' as "column", code as value from cat union all select 'patient', patient from cat
  union all select 'date', date from cat
), counted as (
  select "column", value, count(*) as count from entries group by 1, 2
), dict as (
  select *, row_number() over (partition by "column" order by value) - 1 as index,
    row_number() over (partition by "column" order by count desc, value) - 1 as by_frequency,
    count(*) over (partition by "column") as size from counted
)"""


def _categories(spark, sf_dir):
    rows = tables.resources(spark, sf_dir)["MedicationStatement"].df
    return rows.select("id", "code", "patient", F.date_format("date", "yyyy-MM-dd").alias("date"))


@query(
    "category_dictionary",
    with_sql(MED, CATEGORIES_SQL) + """select "column", value, count, index, by_frequency, size from dict""",
)
def category_dictionary(spark, sf_dir):
    """Every value of three columns, numbered alphabetically and by frequency."""
    counts = dictionary.value_counts(_categories(spark, sf_dir), CATEGORIES)
    frequent = dictionary.numbered(counts, "frequency").select("column", "value", F.col("index").alias("by_frequency"))
    return dictionary.numbered(counts).join(frequent, ["column", "value"])


@query(
    "category_sparse_rows",
    with_sql(MED, CATEGORIES_SQL)
    + """select id, cast(c.size + p.size + d.size as bigint) as size,
      concat_ws(',', c.index, c.size + p.index, c.size + p.size + d.index) as positions
    from cat join dict c on c."column" = 'code' and c.value = code
    join dict p on p."column" = 'patient' and p.value = patient
    join dict d on d."column" = 'date' and d.value = date""",
)
def category_sparse_rows(spark, sf_dir):
    """Where the one-hot vector of every statement over all values of three columns holds a 1."""
    rows = materialize(_categories(spark, sf_dir))
    sparse = dictionary.sparse_rows(rows, "id", CATEGORIES, dictionary.dictionary(rows, CATEGORIES))
    return sparse.withColumn("positions", F.concat_ws(",", F.transform("positions", lambda p: p.cast("string"))))


# --- learning inputs --------------------------------------------------------


@query(
    "impute_mean",
    LIGHT_WITH
    + """select pid, round(coalesce(balance, (select avg(balance) from light)), 6) as "balance_NUM",
    round(coalesce(age, (select avg(age) from light)), 6) as "age_NUM" from light""",
)
def impute_mean(spark, sf_dir):
    rows = encode.impute(light(spark, sf_dir), ["balance", "age"], "mean")
    return _rounded(rows.select("pid", "balance_NUM", "age_NUM"), "balance_NUM", "age_NUM")


@query(
    "impute_median",
    LIGHT_WITH
    + """select pid, balance, balance is null as filled_balance, age is null as filled_age, true as is_median from light""",
)
def impute_median(spark, sf_dir):
    """The median is approximate: what fills a gap must have its rank within a hundredth."""
    rows = encode.impute(light(spark, sf_dir), ["balance", "age"], "median")
    sound = F.lit(True)
    for c in ("balance", "age"):
        filled = rows.select(F.when(F.col(c).isNull(), F.col(f"{c}_NUM")).alias("v")).agg(F.max("v")).scalar()
        bounds = rows.agg(F.percentile(c, F.array(F.lit(0.49), F.lit(0.51)))).scalar()
        sound = sound & F.coalesce(filled.between(bounds[0], bounds[1]), F.lit(True))
        sound = sound & F.when(F.col(c).isNull(), F.col(f"{c}_NUM") == filled).otherwise(F.col(f"{c}_NUM") == F.col(c))
    return rows.select(
        "pid", "balance", F.col("balance").isNull().alias("filled_balance"), F.col("age").isNull().alias("filled_age"),
        sound.alias("is_median"),
    )


INDEX_SQL = """indexed as (
  select light.*, coalesce(i, (select count(distinct segment) from light)) as idx
  from light left join (select segment as s, row_number() over (order by segment) - 1 as i
                        from (select distinct segment from light where segment is not null)) on s = segment)"""


@query(
    "string_index",
    with_sql(PAT, LIGHT_SQL, INDEX_SQL) + 'select pid, segment, cast(idx as double) as "segment_INDEX" from indexed',
)
def string_index(spark, sf_dir):
    return encode.string_index(light(spark, sf_dir), ["segment"]).select("pid", "segment", "segment_INDEX")


def _staged(rows, *variables, **tuning):
    """Rows through the feature stages that every classifier gets."""
    stages = feature_stages(Featureset(variables), Algorithm(LOGISTIC_REGRESSION, tuning))
    return Pipeline(stages=stages).fit(rows).transform(rows)


@query(
    "onehot_vector",
    with_sql(PAT, LIGHT_SQL, INDEX_SQL)
    + """select pid, cast(case when idx < k then idx + 1 else 0 end as bigint) as position, k as size
    from indexed, (select count(distinct segment) as k from light)""",
)
def onehot_vector(spark, sf_dir):
    """The position of the 1 in each vector, 0 if there is none, and the vector's size."""
    encoded = _staged(light(spark, sf_dir), Variable("segment", "/Patient", "value:segment", CATEGORICAL))
    array = vector_to_array("segment_VEC")
    return encoded.select(
        "pid", F.array_position(array, 1.0).alias("position"), F.size(array).cast("long").alias("size")
    )


@query(
    "assemble_vector",
    LIGHT_WITH
    + """select pid, age as first, round(coalesce(balance, (select avg(balance) from light)), 6) as second from light""",
)
def assemble_vector(spark, sf_dir):
    rows = light(spark, sf_dir)
    staged = _staged(rows, *[Variable(c, "/Patient", f"value:{c}") for c in ("age", "balance")], imputation_strategy="mean")
    array = vector_to_array("nonScaledFeatures")
    return staged.select("pid", array[0].alias("first"), F.round(array[1], 6).alias("second"))


@query(
    "label_index",
    LIGHT_WITH
    + """select pid, segment, cast(i as double) as label from light
    join (select segment as s, row_number() over (order by count(*) desc, segment) - 1 as i
          from light where segment is not null group by 1) on s = segment""",
)
def label_index(spark, sf_dir):
    rows = encode.label_index(light(spark, sf_dir), "segment", handle_invalid="skip")
    return rows.select("pid", "segment", "label")


@query(
    "minmax_scale",
    with_sql(PAT)
    + """select pid, round((age - (select min(age) from pat)) / (select max(age) - min(age) from pat), 6) as "age_SCALED",
    round((balance - (select min(balance) from pat)) / (select max(balance) - min(balance) from pat), 6) as "balance_SCALED",
    cast(0.5 as double) as "one_SCALED" from pat""",
)
def minmax_scale(spark, sf_dir):
    rows = tables.patients(spark, sf_dir).df.select(F.col("ref").alias("pid"), "age", "balance", F.lit(1.0).alias("one"))
    scaled = encode.minmax_scale(rows, ["age", "balance", "one"])
    return _rounded(scaled.select("pid", "age_SCALED", "balance_SCALED", "one_SCALED"), "age_SCALED", "balance_SCALED")


@query(
    "minmax_scale_vector",
    with_sql(PAT)
    + """select pid, round((age - (select min(age) from pat)) / (select max(age) - min(age) from pat), 6) as first,
    round((balance - (select min(balance) from pat)) / (select max(balance) - min(balance) from pat), 6) as second
    from pat""",
)
def minmax_scale_vector(spark, sf_dir):
    rows = tables.patients(spark, sf_dir).df.select(F.col("ref").alias("pid"), "age", "balance")
    staged = _staged(rows, *[Variable(c, "/Patient", f"value:{c}") for c in ("age", "balance")])
    array = vector_to_array("features")
    return staged.select(
        "pid", F.round(array[0], 6).alias("first"), F.round(array[1], 6).alias("second")
    )


@query(
    "handle_invalid",
    LIGHT_WITH
    + """select 'skip' as policy, pid, segment, balance from light where segment is not null and balance is not null
    union all select 'keep', pid, segment, balance from light
    union all select 'error', pid, segment, balance from light where segment is not null and balance is not null
    union all select 'error raised', null, null, null from light
      having bool_or(segment is null or balance is null)""",
)
def handle_invalid(spark, sf_dir):
    """``error`` on complete rows gives them all; on the others it raises, which shows as a row."""
    rows = light(spark, sf_dir)
    used = ["segment", "balance"]
    try:
        encode.drop_invalid(rows, used, "error").write.format("noop").mode("overwrite").save()
        raised = rows.limit(0)
    except PySparkException:
        raised = rows.limit(1)
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("pid", *used)]
    errors = encode.drop_invalid(rows.na.drop(subset=used), used, "error")
    parts = [
        encode.drop_invalid(rows, ["segment", "balance"], policy).select(
            F.lit(policy).alias("policy"), "pid", "segment", "balance"
        )
        for policy in ("skip", "keep")
    ]
    parts.append(errors.select(F.lit("error").alias("policy"), "pid", "segment", "balance"))
    parts.append(raised.select(F.lit("error raised").alias("policy"), *none))
    return reduce(DataFrame.unionByName, parts)


SPLIT_SQL = "(cast('0x' || substr(md5(pid || ':11'), 1, 8) as bigint) % 100) < 80"


@query("train_test_split", with_sql(PAT) + f"select pid, site, {SPLIT_SQL} as training from pat")
def train_test_split(spark, sf_dir):
    rows = tables.patients(spark, sf_dir).df
    return rows.select(F.col("ref").alias("pid"), "site", in_training_split(F.col("ref")).alias("training"))
