"""Connected components of an edge list, by minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.session import stage, unstage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, label)`` of every node of an edge; the label is the smallest node of its component.

    Every round sends the smallest label to the neighbours, hooks it on the label's own root and follows labels of labels, so
    that the number of rounds grows with the logarithm of a chain's length. Rounds are staged in the shared folder.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both = stage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-edges", False)
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    labels = stage(nodes.select("node", F.col("node").alias("label")), "cc-labels", False)
    while True:
        sent = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("low"))
        old = labels.join(sent, labels["node"] == sent["a"], "left").select("node", "label", F.least("label", "low").alias("low"))
        hooked = old.select("node", "low").unionByName(old.where("low < label").select(F.col("label").alias("node"), "low"))
        found = hooked.groupBy("node").agg(F.min("low").alias("low"))
        jump = found.select(F.col("node").alias("low"), F.col("low").alias("root"))
        was = labels.select("node", F.col("label").alias("was"))
        new = found.join(jump, "low").select("node", F.least("low", "root").alias("label")).join(was, "node")
        nxt = stage(new.select("node", "label", (F.col("label") < F.col("was")).alias("moved")), "cc-labels", False)
        unstage(labels)
        labels = nxt.select("node", "label")
        labels.staged_path = nxt.staged_path
        if nxt.where("moved").isEmpty():
            return labels
