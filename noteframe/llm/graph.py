"""Connected components of a link table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteframe.llm.common import FEW, gathered, sent


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node that links lead to.

    Each round a node takes the smallest label among its own and its neighbours', and then the label that this label had
    (pointer jumping), so labels travel far further than one link a round. A round is written to the checkpoint folder;
    it ends when a round changes nothing. Small tables of labels are sent to the links. Nothing but counts reaches the driver.
    """
    both = gathered(links.where("a != b").select("a", "b").union(links.where("a != b").select("b", "a")).distinct())
    size = both.count()  # no fewer than nodes
    labels = gathered(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), size)
    send = F.broadcast if size <= FEW else (lambda x: x)
    while True:
        near = both.join(send(labels), both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = near.join(send(labels), "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        hop = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        moved = gathered(step.join(send(hop), "root", "left").select("node", "old", F.least("root", "further").alias("root")), size)
        labels = moved.select("node", "root")
        if moved.where("root != old").isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (node, root) of components(), after further links (a, b): only the classes that these join are worked on again."""
    ends, known = links, sent(labels)
    for x in "ab":
        ends = ends.join(known.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left").withColumn(x, F.coalesce(f"root_{x}", x)).drop(f"root_{x}")
    ends = gathered(ends.where("a != b").distinct())
    if ends.isEmpty():
        return labels
    joined = components(ends)
    moved = labels.join(sent(joined).select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left")
    new = joined.join(known, "node", "left_anti")
    return gathered(moved.select("node", F.coalesce("further", "root").alias("root")).union(new.select("node", "root")))
