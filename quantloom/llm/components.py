"""Connected components of a graph with bounded degree, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(pairs: DataFrame) -> DataFrame:
    """``node, label`` for each node of ``pairs`` (columns ``a, b``): the label is the smallest node of its component.

    Each round gives a node the least label among its neighbours, then the label of its label (pointer jumping), so a
    chain's labels travel in doubling steps. Rounds end when none changes a label. Nothing reaches the driver but counts.
    """
    edges = settle(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "components-edges")
    labels = settle(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "components")
    while True:
        around = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        told = labels.join(around, labels["node"] == around["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        new = settle(told.join(jump, told["label"] == jump["at"]).select("node", "old", F.least("label", "beyond").alias("label")), "components")
        changed = not new.where("old <> label").isEmpty()
        labels = new.select("node", "label")
        if not changed:
            return labels
