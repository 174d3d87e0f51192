"""Connected components of a graph of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of ``edges``: the smallest node that it reaches.

    Each round takes the smallest label among a node's neighbours, then the
    label of that label, so chains shorten by doubling.  A round's labels
    are written; the rounds end when none changes.  Edges with a null end
    are skipped; an empty graph gives no rows.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    both = written(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = written(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")).withColumnRenamed("x", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("label").alias("near")).withColumnRenamed("x", "node")
        own = labels.join(near, "node").select("node", F.least("label", "near").alias("via"), F.col("label").alias("old"))
        of_label = labels.select(F.col("node").alias("via"), F.col("label").alias("beyond"))
        new = written(own.join(of_label, "via").select("node", F.least("via", "beyond").alias("label"), "old"), "labels")
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
