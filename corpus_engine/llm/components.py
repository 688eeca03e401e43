"""Connected components by repeated joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_engine.runtime import durable


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``edges`` (``a, b``): the smallest node it is linked to.

    Each round a node takes the smallest label next to it, then its label's label,
    so that chains shrink by halves. Labels are written to the shared folder.
    """
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = durable(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        own = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        far = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        moved = durable(own.join(far, "via", "left").select("node", "old", F.least("via", F.coalesce("far", "via")).alias("label")))
        labels = moved.select("node", "label")
        if moved.filter("label <> old").isEmpty():
            return labels
