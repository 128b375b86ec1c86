"""Pages of a search result that name each other: found again as chains and checked.

A page is a bundle with its own address, the address of the next page, and the number of resources in the
whole result. Addresses are followed for all results at once by doubling steps (a page learns its first
page in as many joins as the logarithm of the chain's length); only addresses and counts take part, not
the bundles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortweave.session import materialize

PAGE_SCHEMA = "entry array<string>, link array<struct<relation: string, url: string>>, total bigint"
# Entries that are objects can be counted without a copy of their text; others make the list null or have a null in it.
_OBJECTS = "entry array<struct<request: struct<method: string>>>, link array<struct<relation: string, url: string>>, total bigint"


def _link(relation: str) -> Column:
    return F.get(F.filter("p.link", lambda x: x["relation"] == relation), 0)["url"]


def _address(column: str) -> Column:
    return F.get(F.filter(F.from_json(column, PAGE_SCHEMA)["link"], lambda x: x["relation"] == "self"), 0)["url"]


def _counted(column: str) -> Column:
    """The number of a page's entries, whatever they are, its links and total."""
    page = F.from_json(column, PAGE_SCHEMA)
    return F.struct(F.coalesce(F.size(page["entry"]), F.lit(0)).alias("entries"), page["link"].alias("link"), page["total"].alias("total"))


def page_chains(bundles: DataFrame, column: str = "value") -> DataFrame:
    """A row per address: ``page``, ``next``, ``chain`` (its first page), ``position``, ``entries``, ``total``,
    ``copies`` (bundles of that address), ``missing`` (the next page is not there).

    Pages that no first page leads to go round in a circle: their ``chain`` and ``position`` are null. Of
    several pages that name one as their next the smallest address counts. Bundles without an address
    of their own are single, not pages, and have no row; nor have texts that are no bundles.
    """
    told = bundles.select(F.col(column).alias("_text"), F.from_json(column, _OBJECTS).alias("o"))
    objects = F.coalesce(F.forall("o.entry", lambda e: e.isNotNull()), F.lit(False))
    pages = told.select(F.when(objects, F.struct(F.size("o.entry").alias("entries"), "o.link", "o.total")).otherwise(_counted("_text")).alias("p")).select(
        _link("self").alias("page"), _link("next").alias("next"), "p.entries", "p.total"
    )
    once = pages.where("page is not null").groupBy("page").agg(
        F.min("next").alias("next"), F.sum("entries").alias("entries"), F.max("total").alias("total"),
        F.count(F.lit(1)).alias("copies"),
    )
    once = materialize(once)
    before = once.where("next is not null").groupBy(F.col("next").alias("page")).agg(F.min("page").alias("before"))
    walk = once.select("page").join(before, "page", "left").select(
        "page", F.coalesce("before", "page").alias("head"),
        F.col("before").isNotNull().cast("long").alias("depth"), F.col("before").isNull().alias("done"),
    )
    walk = materialize(walk)
    for _ in range(math.ceil(math.log2(max(2, once.count()))) + 1):
        if walk.where("not done").isEmpty():
            break
        # The heads of pages under way differ within a chain, so no page is asked for by many.
        asked = walk.select(F.col("page").alias("head"), *[F.col(c).alias(f"_{c}") for c in ("head", "depth", "done")])
        moved = walk.where("not done").join(asked, "head").select(
            "page", F.col("_head").alias("head"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done")
        )
        walk = materialize(walk.where("done").unionByName(moved))
    there = once.select(F.col("page").alias("next"), F.lit(True).alias("_there"))
    return (
        once.join(walk, "page")
        .join(there, "next", "left")
        .select(
            "page", "next", F.when(F.col("done"), F.col("head")).alias("chain"), F.when(F.col("done"), F.col("depth")).alias("position"),
            "entries", "total", "copies", (F.col("next").isNotNull() & F.col("_there").isNull()).alias("missing"),
        )
    )


def chain_problems(chains: DataFrame) -> DataFrame:
    """``(chain, reason)``: what is wrong with the chains of :func:`page_chains`; a sound chain has no row.

    Counts are combined before the shuffle. A chain whose pages give no total is not checked against one.
    """
    summed = chains.groupBy("chain").agg(
        F.sum("entries").alias("entries"), F.max("total").alias("most"), F.min("total").alias("least"),
        F.max("copies").alias("copies"), F.max("missing").alias("missing"),
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.col("chain").isNull(), "pages in a circle"),
            F.when(F.col("missing"), "next page is missing"),
            F.when(F.col("copies") > 1, "page given twice"),
            F.when(F.col("chain").isNotNull() & ((F.col("most") != F.col("entries")) | (F.col("least") != F.col("entries"))), "total differs"),
        )
    )
    return summed.select("chain", F.explode(reasons).alias("reason"))


def sound_bundles(bundles: DataFrame, chains: DataFrame, column: str = "value") -> DataFrame:
    """``bundles`` without those of chains that have a problem; single bundles stay."""
    broken = chain_problems(chains).select("chain").distinct()
    # Written first, so that Spark knows that they are few and moves no bundles.
    pages = materialize(chains.join(broken, chains["chain"].eqNullSafe(broken["chain"]), "left_semi").select(F.col("page").alias("_page")))
    if pages.isEmpty():
        return bundles  # nothing to leave out: no text is parsed for its address
    return bundles.withColumn("_page", _address(column)).join(pages, "_page", "left_anti").drop("_page")
