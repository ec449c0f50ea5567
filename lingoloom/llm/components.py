"""Connected components of a table of links, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of a link and the smallest node that it reaches.

    Each round takes the least label among a node's neighbours, then the label of that label, so the number of rounds
    grows with the logarithm of the longest path. Labels are staged in the shared folder each round; nothing is
    collected but whether labels have changed. Minima are pre-aggregated, so a hub's links don't meet in one task.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = staged(pairs.union(pairs.select("v", "u")).distinct(), "edges")
    labels = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label"))
    labels = staged(labels, "labels")
    while True:
        near = edges.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("near"))
        new = labels.join(near, F.col("node") == F.col("u")).select("node", "label", F.least("label", "near").alias("to"))
        up = labels.select(F.col("node").alias("to"), F.col("label").alias("above"))
        new = new.join(up, "to", "left").select("node", F.col("label").alias("old"), F.least("to", F.coalesce("above", "to")).alias("label"))
        new = staged(new, "labels")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")
