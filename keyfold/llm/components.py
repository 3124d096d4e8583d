"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, lookup


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable from each node of ``links``.

    Every round takes the least label of the neighbours (a combined aggregation, and a lookup that
    sets hubs apart, so a hub costs no task more than others) and then the label of the label;
    rounds grow with the logarithm of the longest shortest path.  Links to oneself are allowed, nulls are not.
    """
    one_way = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = checkpoint(one_way.union(one_way.select("other", "node")).distinct())
    labels = checkpoint(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    while True:
        near = lookup(both, labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = checkpoint(labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("before")))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = checkpoint(lookup(lower, jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "before"))
        if after.where("label <> before").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
