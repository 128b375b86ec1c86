"""Federated association rules: frequent items over all sites, rules per site, merge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.operators import rules as R
from cohortweave.operators.encode import items_array
from cohortweave.session import materialize


@dataclass(frozen=True)
class Mined:
    frequencies: DataFrame
    frequent_items: DataFrame
    itemsets: DataFrame
    site_rules: DataFrame
    rules: DataFrame


def federated_rules(
    dataset: DataFrame,
    min_support: float = R.MIN_SUPPORT,
    min_confidence: float = R.MIN_CONFIDENCE,
    local_support: float = 0.0,
) -> Mined:
    """Rules over all sites of ``dataset(site, pid, ...)``.

    Between the steps only counts of items and itemsets are passed on. The totals of
    the sites come to the driver; items and rows never do. Each site's rules come from
    the itemsets that have ``local_support`` there; merged figures from exact counts of
    all candidates at all sites.
    """
    transactions = items_array(dataset, keep=("site", "pid"))
    long = transactions.select("site", "pid", F.explode("items").alias("item"))
    frequencies = R.item_frequencies(long)
    records = materialize(R.record_counts(transactions))
    frequent = materialize(R.global_frequent_items(frequencies, records, min_support))
    totals = {row["site"]: row["records"] for row in records.collect()}
    # Counts of itemsets are small, and the steps below read them many times.
    itemsets = materialize(R.frequent_itemsets(transactions, frequent, local_support))
    site_rules = R.association_rules(itemsets.filter("local"), records, min_confidence)
    if len(totals) == 1:
        # With one site its own figures stand.
        merged = site_rules.drop("site")
    else:
        counts = R.merge_itemset_counts(itemsets)
        merged = R.rule_confidence_lift(R.merge_rules(site_rules), counts, sum(totals.values()))
    return Mined(frequencies, frequent, itemsets, site_rules, merged)
