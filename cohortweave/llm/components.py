"""Connected components of an edge table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.session import materialize


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node of an edge; label is the smallest node that can be reached.

    Every round takes the smallest label among neighbours and then the label's own label, so that
    distances halve; labels are written after every round.
    """
    there = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = materialize(there.unionByName(there.select(F.col("other").alias("node"), F.col("node").alias("other"))))
    labels = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")))
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "other", "label": "near"}), "other")
        near = near.groupBy("node").agg(F.min("near").alias("near"))
        lower = labels.join(near, "node").select(
            "node", "label", F.least("label", "near").alias("lower")
        )
        of = labels.select(F.col("node").alias("lower"), F.col("label").alias("jump"))
        made = materialize(
            lower.join(of, "lower").select("node", F.col("jump").alias("label"), (F.col("jump") != F.col("label")).alias("moved"))
        )
        moved = made.where("moved").limit(1).count()
        labels = made.select("node", "label")
        if not moved:
            return labels
