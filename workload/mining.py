"""Association rules over patients of five sites."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortweave.operators import rules as R
from cohortweave.operators.encode import items_array, items_long
from cohortweave.operators.features import prepare_features
from cohortweave.plans.association import federated_rules
from cohortweave.session import materialize
from cohortweave.spec import CATEGORICAL, Featureset, Variable
from workload import tables
from workload.preparation import BANDS_SQL
from workload.registry import query
from workload.tables import MED, PAT, with_sql

MIN_SUPPORT = 0.15
BRANDS = ("Brand#4", "Brand#7", "Brand#12", "Brand#23")

MINED = Featureset(
    (
        Variable("site", "/Patient", "value:site", CATEGORICAL, role="site"),
        Variable("segment", "/Patient", "value:nullif(segment, 'BUILDING')", CATEGORICAL),
        Variable("age", "/Patient", "value:age"),
        *(Variable(b, f"/MedicationStatement?code={b}", "value:exists") for b in BRANDS),
    )
)


def dataset(spark, sf_dir):
    """``(site, pid, segment, age, Brand4, ...)``, one row per patient, stored before it is mined."""
    return materialize(prepare_features(tables.resources(spark, sf_dir), MINED))


def _text(df, *columns):
    return df.withColumns({c: F.concat_ws("|", c) for c in columns})


_BRAND_ITEMS = "\n".join(
    f"""  union all select site, pid, '{b.replace("#", "")}' from pat where pid in (select subj from med where brand = '{b}')"""
    for b in BRANDS
)

ITEMS = f"""items as (
  select site, pid, 'segment_' || segment as item from pat where segment <> 'BUILDING'
  union all select site, pid, 'age_' || {BANDS_SQL} from pat
{_BRAND_ITEMS})"""

RECORDS = "records as (select site, count(*) as n from pat group by 1)"

FREQUENT = f"""frequent as (
  select item, freq, support, row_number() over (order by item) - 1 as bit from (
    select item, count(*) as freq, cast(count(*) as double) / (select count(*) from pat) as support
    from items group by 1) where support >= cast({MIN_SUPPORT} as double))"""

# Itemsets as bit masks over the frequent items.
ITEMSETS = """patterns as (
  select site, mask, count(*) as n from (
    select site, pid, cast(sum(1 << bit) as bigint) as mask from items join frequent using (item) group by 1, 2)
  group by 1, 2),
masks as (select unnest(range(1, cast(1 << (select count(*) from frequent) as bigint))) as m),
itemsets as (
  select site, m, cast(sum(n) as bigint) as freq from patterns, masks where mask & m = m group by 1, 2),
names as (
  select m, string_agg(item, '|' order by item) as items, count(*) as size
  from masks join frequent on (m >> bit) & 1 = 1 group by 1)"""

SITE_RULES = f"""siterules as (
  select s.site, s.a, s.c, cast(s.freq as double) / x.freq as confidence,
         cast(s.freq as double) / x.freq / (cast(y.freq as double) / n) as lift
  from (select site, m, m - (1 << bit) as a, cast(1 << bit as bigint) as c, itemsets.freq
        from itemsets join names using (m) join frequent on (m >> bit) & 1 = 1 where size > 1) s
  join itemsets x on x.site = s.site and x.m = s.a
  join itemsets y on y.site = s.site and y.m = s.c
  join records on records.site = s.site
  where cast(s.freq as double) / x.freq >= cast({R.MIN_CONFIDENCE} as double))"""

MERGED = """counts as (select m, cast(sum(freq) as bigint) as freq from itemsets group by 1),
merged as (
  select r.a, r.c, cast(b.freq as double) / x.freq as confidence,
         cast(b.freq as double) / x.freq / (cast(y.freq as double) / (select count(*) from pat)) as lift
  from (select distinct a, c from siterules) r
  join counts b on b.m = r.a + r.c join counts x on x.m = r.a join counts y on y.m = r.c)"""

BASE = (PAT, MED, ITEMS, RECORDS, FREQUENT)
ITEMSETS_WITH = with_sql(*BASE, ITEMSETS)
RULES_WITH = with_sql(*BASE, ITEMSETS, SITE_RULES)
MERGED_WITH = with_sql(*BASE, ITEMSETS, SITE_RULES, MERGED)


def _transactions(spark, sf_dir):
    return items_array(dataset(spark, sf_dir), keep=("site", "pid"))


def _frequent(transactions):
    frequencies = R.item_frequencies(transactions.select("site", F.explode("items").alias("item")))
    return R.global_frequent_items(frequencies, R.record_counts(transactions), MIN_SUPPORT)


@query(
    "item_frequencies",
    with_sql(PAT, MED, ITEMS, RECORDS)
    + "select site, item, count(*) as freq, any_value(n) as records from items join records using (site) group by 1, 2",
)
def item_frequencies(spark, sf_dir):
    rows = dataset(spark, sf_dir)
    frequencies = R.item_frequencies(items_long(rows, keep=("site", "pid")))
    return frequencies.join(R.record_counts(rows), "site")


@query(
    "global_frequent_items",
    with_sql(*BASE) + "select item, freq, round(support, 6) as support from frequent",
)
def global_frequent_items(spark, sf_dir):
    rows = dataset(spark, sf_dir)
    frequencies = R.item_frequencies(items_long(rows, keep=("site", "pid")))
    frequent = R.global_frequent_items(frequencies, R.record_counts(rows), MIN_SUPPORT)
    return frequent.withColumn("support", F.round("support", 6))


@query(
    "batch_transactions",
    with_sql(*BASE)
    + """select site, pid, coalesce(string_agg(item, '|' order by item) filter (bit is not null), '') as items
    from pat left join items using (site, pid) left join frequent using (item) group by 1, 2""",
)
def batch_transactions(spark, sf_dir):
    """Rows as transactions over the frequent items."""
    transactions = _transactions(spark, sf_dir)
    return _text(R.keep_items(transactions, _frequent(transactions)), "items")


ITEMSETS_SQL = ITEMSETS_WITH + "select site, items, freq from itemsets join names using (m)"


@query("frequent_itemsets", ITEMSETS_SQL)
def frequent_itemsets(spark, sf_dir):
    transactions = _transactions(spark, sf_dir)
    return _text(R.frequent_itemsets(transactions, _frequent(transactions)).drop("local"), "items")


@query("frequent_itemsets_fpgrowth", ITEMSETS_SQL)
def frequent_itemsets_fpgrowth(spark, sf_dir):
    """The same by FP-growth at each site, with local support 0."""
    transactions = _transactions(spark, sf_dir)
    kept = R.keep_items(transactions, _frequent(transactions))
    sites = [row["site"] for row in R.record_counts(kept).orderBy("site").collect()]
    return _text(R.fp_growth_itemsets(kept, sites), "items")


RULE_COLUMNS = "a.items as antecedent, c.items as consequent, round(confidence, 6) as confidence, round(lift, 6) as lift"


def _rounded_rules(rules):
    rounded = rules.withColumns({c: F.round(c, 6) for c in ("confidence", "lift")})
    return _text(rounded, "antecedent", "consequent")


def _itemsets(spark, sf_dir):
    transactions = _transactions(spark, sf_dir)
    return transactions, materialize(R.frequent_itemsets(transactions, _frequent(transactions)))


@query(
    "association_rules",
    RULES_WITH + f"select site, {RULE_COLUMNS} from siterules r join names a on a.m = r.a join names c on c.m = r.c",
)
def association_rules(spark, sf_dir):
    transactions, itemsets = _itemsets(spark, sf_dir)
    return _rounded_rules(R.association_rules(itemsets, R.record_counts(transactions)))


@query(
    "itemset_normalize",
    ITEMSETS_WITH + "select items, count(*) as sites from itemsets join names using (m) group by 1",
)
def itemset_normalize(spark, sf_dir):
    """Itemsets with their items in any order become equal once normalized."""
    _, itemsets = _itemsets(spark, sf_dir)
    shuffled = itemsets.withColumn(
        "items", F.when(F.col("site") < "ASIA", F.reverse("items")).otherwise(F.col("items"))
    )
    normal = R.normalize_itemsets(shuffled)
    return _text(normal.groupBy("items").agg(F.count(F.lit(1)).alias("sites")), "items")


@query(
    "merge_itemset_counts",
    ITEMSETS_WITH + "select items, cast(sum(freq) as bigint) as freq from itemsets join names using (m) group by 1",
)
def merge_itemset_counts(spark, sf_dir):
    return _text(R.merge_itemset_counts(_itemsets(spark, sf_dir)[1]), "items")


@query(
    "merge_rules_distinct",
    RULES_WITH
    + """select distinct a.items as antecedent, c.items as consequent
    from siterules r join names a on a.m = r.a join names c on c.m = r.c""",
)
def merge_rules_distinct(spark, sf_dir):
    transactions, itemsets = _itemsets(spark, sf_dir)
    rules = R.association_rules(itemsets, R.record_counts(transactions))
    return _text(R.merge_rules(rules), "antecedent", "consequent")


MERGED_SQL = MERGED_WITH + f"select {RULE_COLUMNS} from merged r join names a on a.m = r.a join names c on c.m = r.c"


@query("rule_confidence_lift", MERGED_SQL)
def rule_confidence_lift(spark, sf_dir):
    transactions, itemsets = _itemsets(spark, sf_dir)
    records = R.record_counts(transactions)
    rules = R.merge_rules(R.association_rules(itemsets, records))
    total = records.agg(F.sum("records")).first()[0]
    return _rounded_rules(R.rule_confidence_lift(rules, R.merge_itemset_counts(itemsets), total))


# So low a support that all of the 14 and more items count.
LOW_SUPPORT = 0.0
LOCAL_SUPPORT = 0.05
LOW_FREQUENT = FREQUENT.replace(f"cast({MIN_SUPPORT} as double)", f"cast({LOW_SUPPORT} as double)")


def _merged_sql(*parts):
    return with_sql(PAT, MED, ITEMS, RECORDS, *parts, MERGED) + MERGED_SQL[len(MERGED_WITH) :]


@query("federated_rules", MERGED_SQL)
def federated_rules_query(spark, sf_dir):
    return _rounded_rules(federated_rules(dataset(spark, sf_dir), MIN_SUPPORT).rules)


@query("federated_rules_many_items", _merged_sql(LOW_FREQUENT, ITEMSETS, SITE_RULES))
def federated_rules_many_items(spark, sf_dir):
    """The same with every item."""
    return _rounded_rules(federated_rules(dataset(spark, sf_dir), LOW_SUPPORT).rules)


# Rules of a site from the itemsets that have the support there; all counts for the merged figures.
LOCAL_RULES = SITE_RULES.replace(
    "from itemsets join names using (m)", f"""from (select itemsets.* from itemsets join records using (site)
    where freq >= ceil(n * cast({LOCAL_SUPPORT} as double))) itemsets join names using (m)""")  # fmt: skip


@query("federated_rules_local_support", _merged_sql(LOW_FREQUENT, ITEMSETS, LOCAL_RULES))
def federated_rules_local_support(spark, sf_dir):
    """Candidates with a support at some site, counted exactly at every site."""
    return _rounded_rules(federated_rules(dataset(spark, sf_dir), LOW_SUPPORT, local_support=LOCAL_SUPPORT).rules)
