"""Connected components by smallest label, with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscrub.llm.staging import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (node, label): the smallest node reachable. Each round is a staged table.

    Hubs are no hot keys: minima are combined before the shuffle, and the joins hold one row of a
    node on one side, so that adaptive execution can split the other.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = stage(both.distinct(), "cc-edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "cc-labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = stage(lower.join(jump, "via", "left").select("node", F.least("via", F.coalesce("far", "via")).alias("label"), "old"), "cc-labels")
        if not new.where("label <> old").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")
