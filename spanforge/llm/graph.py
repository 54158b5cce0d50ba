"""Connected components of a link table, by minimum labels with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, written


def components(links: DataFrame) -> DataFrame:
    """``links``: a, b. Per linked node: node, label (least node of its component).

    Every round each node takes the least label of its neighbours (a partial aggregation, so hubs do no harm) and then
    its label's label. The number of rounds grows with the logarithm of the longest chain of labels, not with the data.
    """
    both = checkpointed(links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        moved = written(labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        jumps = moved.select(F.col("node").alias("at"), F.col("label").alias("jump"))
        new = checkpointed(moved.join(jumps, moved.label == jumps["at"], "left").select("node", "old", F.coalesce(F.least("label", "jump"), "label").alias("label")))
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
