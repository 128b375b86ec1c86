"""Association rules: item frequencies, itemsets, rules, and their merge across sites.

Itemsets are counted on vertical bitmaps: for every site and every 64 rows, one word per item
says which of the rows have it. A candidate's count is the number of bits that its items' words
have in common, so no subset of a row is ever written, only the counts of a level. All sites are
counted in one plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from math import comb

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortweave.session import materialize

# Support over all sites, and confidence within a site.
MIN_SUPPORT = 0.3
MIN_CONFIDENCE = 0.8
# Candidates that are counted side by side; more are counted in blocks.
CANDIDATES = 20_000


def itemset_key(items: Column) -> Column:
    """The itemset in one order, so that equal sets compare, group and join as equal."""
    return F.array_sort(items)


def item_frequencies(items: DataFrame, by: Sequence[str] = ("site",)) -> DataFrame:
    """Rows having each item, from the long form ``(by, pid, item)``."""
    return items.groupBy(*by, "item").agg(F.count(F.lit(1)).alias("freq"))


def record_counts(rows: DataFrame, by: Sequence[str] = ("site",)) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("records"))


def global_frequent_items(
    frequencies: DataFrame, records: DataFrame, min_support: float = MIN_SUPPORT
) -> DataFrame:
    """Items whose share of all records of all sites is at least ``min_support``.

    Both inputs are site-sized; the number of records becomes a literal.
    """
    total = records.agg(F.sum("records").alias("n")).first()["n"] or 0
    return (
        frequencies.groupBy("item")
        .agg(F.sum("freq").alias("freq"))
        .withColumn("support", F.col("freq").cast("double") / F.lit(float(total)))
        .filter(F.col("support") >= min_support)
    )


def keep_items(transactions: DataFrame, items: DataFrame) -> DataFrame:
    """Transactions with only the ``item`` values of ``items`` left; rows stay even when empty.

    The items are handed to the rows as the value of a scalar subquery. Frequent items are few:
    at most the mean number of items in a row, divided by the support.
    """
    wanted = items.agg(F.collect_list(F.col("item").cast("string")).alias("wanted")).scalar()
    return transactions.withColumn("items", F.array_intersect("items", wanted))


def distinct_transactions(transactions: DataFrame, by: Sequence[str] = ("site",)) -> DataFrame:
    """``(by, items, n)``: each distinct set of items and how many rows have it."""
    return (
        transactions.groupBy(*by, F.array_sort("items").alias("items")).agg(F.count(F.lit(1)).alias("n"))
    )


def fp_growth(
    transactions: DataFrame,
    min_support: float = 0.0,
    min_confidence: float = MIN_CONFIDENCE,
    partitions: int | None = None,
):
    """The fitted FP-growth model of one site's transactions."""
    growth = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence)
    if partitions:
        growth = growth.setNumPartitions(partitions)
    return growth.fit(transactions)


def item_numbers(items: DataFrame) -> DataFrame:
    """``(item, no)``: the distinct items numbered from 0 in sorted order. Frequent items are few."""
    distinct = items.select(F.col("item").cast("string").alias("item")).filter("item is not null").distinct()
    return distinct.withColumn("no", F.row_number().over(Window.orderBy("item")) - 1)


def vertical_words(transactions: DataFrame, numbers: DataFrame, n_items: int) -> DataFrame:
    """``(site, word, bits)``: for 64 rows of a site, at each item's number the rows that have the item.

    Only words with an item are there. Rows are numbered once and stored, so that a repeated task
    cannot number them differently.
    """
    rows = materialize(
        transactions.select("site", "items")
        .sortWithinPartitions("site")  # so that the 64 rows of a word are mostly of one site
        .withColumn("row", F.monotonically_increasing_id())
    )
    bit = F.expr("shiftleft(1L, cast(row & 63 as int))")
    long = rows.select("site", F.shiftright("row", 6).alias("word"), bit.alias("bit"), F.explode("items").alias("item"))
    words = long.join(numbers, "item").groupBy("site", "word", "no").agg(F.bit_or("bit").alias("bits"))
    of = F.map_from_entries(F.collect_list(F.struct("no", "bits")))
    every = F.array(*[F.lit(i) for i in range(n_items)]).cast("array<int>")
    dense = F.transform(every, lambda i: F.coalesce(F.try_element_at("of", i), F.lit(0).cast("long")))
    return words.groupBy("site", "word").agg(of.alias("of")).select("site", "word", dense.alias("bits"))


def first_candidates(numbers: DataFrame, n_items: int) -> tuple[DataFrame, int]:
    """All sets of up to ``size`` items, and that ``size``: the largest with at most CANDIDATES sets, 1 at least."""
    size, total = 1, n_items
    while size < n_items and (total := total + comb(n_items, size + 1)) <= CANDIDATES:
        size += 1
    if size == 1:
        return numbers.select(F.array(F.struct("no", "item")).alias("items")), 1
    # So few items (less than 200) that their names may be part of the plan.
    names = F.array(*[F.struct(F.lit(r["no"]).alias("no"), F.lit(r["item"]).alias("item")) for r in numbers.orderBy("no").collect()])
    sets = [(list(c),) for k in range(1, size + 1) for c in combinations(range(n_items), k)]
    some = numbers.sparkSession.createDataFrame(sets, "at array<int>")
    return some.select(F.transform("at", lambda i: F.get(names, i)).alias("items")), size


def candidate_sets(sets: DataFrame, size: int) -> DataFrame:
    """Sets of ``size`` + 1 items, each ``(no, item)``, whose first and last ``size``-item prefixes are both in ``sets``."""
    prefix = F.slice("items", 1, size - 1).alias("prefix")
    first = sets.select(prefix, F.get("items", F.lit(size - 1)).alias("a"))
    second = sets.select(prefix, F.get("items", F.lit(size - 1)).alias("b"))
    grown = first.join(second, "prefix").filter("a < b")
    return grown.select(F.concat("prefix", F.array("a", "b")).alias("items"))


def count_sets(words: DataFrame, candidates: DataFrame, blocks: int = 1) -> DataFrame:
    """``(site, items, freq)`` of the candidates that occur at a site.

    Candidates are handed to the words as scalar subqueries, in ``blocks`` of a bounded size.
    """
    parts = []
    for k in range(blocks):
        own = candidates.filter(F.pmod(F.xxhash64("items"), F.lit(blocks)) == k) if blocks > 1 else candidates
        asked = F.explode(own.agg(F.collect_list("items")).scalar())
        common = F.aggregate("items", F.lit(-1).cast("long"), lambda held, i: held.bitwiseAND(F.get("bits", i["no"])))
        found = words.select("site", "bits", asked.alias("items")).select("site", "items", common.alias("both"))
        found = found.filter("both <> 0").groupBy("site", "items")
        parts.append(found.agg(F.sum(F.bit_count("both").cast("long")).alias("freq")))
    return reduce(DataFrame.unionByName, parts)


def frequent_itemsets(transactions: DataFrame, items: DataFrame, local_support: float = 0.0) -> DataFrame:
    """``(site, items, freq, local)`` of the itemsets of the frequent ``items``, for all sites in one plan.

    All small sets are counted in one pass, as far as their number is bounded (:func:`first_candidates`).
    Larger ones grow by one item at a time, from two that differ in their last item only. A set stays if it
    has the share ``local_support`` of the records of some site (0: if it occurs). Every set that stays
    is counted exactly at every site, so that counts can be summed; ``local`` says where it has the
    support itself. A null item counts as none; an item twice in a row counts once.
    """
    numbers = materialize(item_numbers(items))
    n_items = numbers.count()
    words = materialize(vertical_words(transactions, numbers, n_items))
    if local_support > 0:
        least = F.greatest(F.lit(1), F.ceil(F.col("records") * local_support)).alias("least")
        bounds = materialize(record_counts(transactions).select("site", least))
    candidates, size = first_candidates(numbers, n_items)
    blocks, levels = 1 if size > 1 else max(1, -(-n_items // CANDIDATES)), []
    while True:
        counts = count_sets(words, candidates, blocks)
        if local_support > 0:
            counts = counts.join(bounds, "site").withColumn("local", F.col("freq") >= F.col("least")).drop("least")
        else:
            counts = counts.withColumn("local", F.lit(True))
        counts = materialize(counts)
        sets = counts.filter("local").select("items").distinct()
        levels.append(counts if local_support == 0 else counts.join(sets, "items", "left_semi").select(counts.columns))
        if size >= n_items:
            break
        sets = sets.filter(F.size("items") == size)
        # How many sets the next level has: pairs of sets that share their prefix.
        alike = sets.groupBy(F.slice("items", 1, size - 1).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        n = alike.agg(F.sum(F.expr("n * (n - 1) div 2")).alias("n")).first()["n"]
        if not n:
            break
        candidates, blocks, size = candidate_sets(sets, size), -(-n // CANDIDATES), size + 1
    found = reduce(DataFrame.unionByName, levels)
    return found.withColumn("items", F.transform("items", lambda i: i["item"]))


def fp_growth_itemsets(transactions: DataFrame, sites: Sequence[str], local_support: float = 0.0) -> DataFrame:
    """The same by FP-growth, one model per site."""
    parts = []
    for site in sites:
        model = fp_growth(transactions.filter(F.col("site") == site), local_support)
        parts.append(
            model.freqItemsets.select(
                F.lit(site).alias("site"), F.array_sort("items").alias("items"), F.col("freq").cast("long")
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _keyed(itemsets: DataFrame) -> DataFrame:
    return itemsets.withColumn("key", itemset_key(F.col("items")))


def _single_consequents(itemsets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every split of an itemset into an antecedent and one consequent."""
    splits = itemsets.filter(F.size("items") > 1).select(
        *by, "items", F.col("freq").alias("freq"), F.explode("items").alias("c")
    )
    return splits.select(
        *by,
        F.array_except("items", F.array("c")).alias("antecedent"),
        F.array("c").alias("consequent"),
        F.col("freq"),
    )


def association_rules(
    itemsets: DataFrame, records: DataFrame, min_confidence: float = MIN_CONFIDENCE, by: Sequence[str] = ("site",)
) -> DataFrame:
    """``(by, antecedent, consequent, confidence, lift)`` from itemset counts.

    Equi-joins on the itemset, never on the site alone.
    """
    keyed = _keyed(itemsets)
    antecedents = keyed.select(*by, F.col("key").alias("a"), F.col("freq").alias("a_freq"))
    consequents = keyed.filter(F.size("items") == 1).select(*by, F.col("key").alias("c"), F.col("freq").alias("c_freq"))
    rules = (
        _single_consequents(itemsets, by)
        .withColumn("a", itemset_key(F.col("antecedent")))
        .withColumn("c", itemset_key(F.col("consequent")))
        .join(antecedents, [*by, "a"])
        .withColumn("confidence", F.col("freq").cast("double") / F.col("a_freq"))
        .filter(F.col("confidence") >= min_confidence)
        .join(consequents, [*by, "c"])
        .join(records, list(by))
    )
    lift = F.col("confidence") / (F.col("c_freq").cast("double") / F.col("records"))
    return rules.select(*by, "antecedent", "consequent", "confidence", lift.alias("lift"))


def normalize_itemsets(itemsets: DataFrame) -> DataFrame:
    """Items in order, so that equal sets compare equal."""
    return itemsets.withColumn("items", F.array_sort("items"))


def normalize_rules(rules: DataFrame) -> DataFrame:
    return rules.withColumns(
        {"antecedent": F.array_sort("antecedent"), "consequent": F.array_sort("consequent")}
    )


def merge_itemset_counts(itemsets: DataFrame) -> DataFrame:
    """Counts of each itemset summed over the sites."""
    return normalize_itemsets(itemsets).groupBy("items").agg(F.sum("freq").alias("freq"))


def merge_rules(rules: DataFrame) -> DataFrame:
    """The distinct (antecedent, consequent) of all sites."""
    return normalize_rules(rules).select("antecedent", "consequent").distinct()


def rule_confidence_lift(rules: DataFrame, itemsets: DataFrame, total_records: int) -> DataFrame:
    """Confidence and lift of merged rules from merged counts.

    Three equi-joins on the itemset. Rules are not filtered by confidence again.
    """
    keyed = _keyed(itemsets).select("key", "freq")

    def count_of(name: str) -> DataFrame:
        return keyed.select(F.col("key").alias(f"{name}_key"), F.col("freq").alias(f"{name}_freq"))

    joined = (
        rules.withColumn("both_key", itemset_key(F.concat("antecedent", "consequent")))
        .withColumn("a_key", itemset_key(F.col("antecedent")))
        .withColumn("c_key", itemset_key(F.col("consequent")))
        .join(count_of("both"), "both_key")
        .join(count_of("a"), "a_key")
        .join(count_of("c"), "c_key")
    )
    confidence = F.col("both_freq").cast("double") / F.col("a_freq").cast("double")
    support = F.col("c_freq").cast("double") / F.lit(float(total_records))
    return joined.withColumn("confidence", confidence).select(
        "antecedent", "consequent", "confidence", (F.col("confidence") / support).alias("lift")
    )
