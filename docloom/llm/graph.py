"""Connected components by hooking to the least neighbour and pointer jumping, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label for every node of links (a, b): label is the least node that it reaches.

    Nodes may be of any orderable type; repeated links and links of a node to itself change nothing. A round joins
    labels to links, takes the least per node and follows labels of labels; it ends when no label changes. Each
    round's tables are dropped once the next stands.
    """
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst"))).filter("src <> dst")
    both = scratch.keep(both.distinct(), "both")
    labels = scratch.keep(both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.src == labels.node).groupBy(F.col("dst").alias("near_node")).agg(F.min("label").alias("near"))
        hooked = scratch.keep(labels.join(near, labels.node == near.near_node).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "hooked")
        over = labels.select(F.col("node").alias("via"), F.col("label").alias("jump"))
        jumped = hooked.join(over, hooked.label == over.via, "left").select("node", "old", F.least("label", F.coalesce("jump", "label")).alias("label"))
        jumped = scratch.keep(jumped, "labels")
        scratch.drop(hooked, labels)
        if jumped.filter("label <> old").isEmpty():
            scratch.drop(both)
            return scratch.renamed(jumped, jumped.select("node", "label"))
        labels = scratch.renamed(jumped, jumped.select("node", "label"))
