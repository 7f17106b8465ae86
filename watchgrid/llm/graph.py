"""Connected components by label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchgrid.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of the component of every node of ``edges`` (a, b).

    Every round each node looks at its neighbours' labels' labels.  The least one
    becomes the label of the node and of its former label, so that whole trees move
    at once and the number of rounds grows with the logarithm of the longest chain.
    All minima are sums that tasks make in part, so a node with very many links is no
    bottleneck.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.where("a <> b").distinct(), "component-edges")
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node")
    labels = materialize(labels, "component-labels")
    while True:
        above = labels.select(F.col("node").alias("__n"), F.col("label").alias("far"))
        known = labels.join(above, F.col("label") == F.col("__n")).select("node", "label", "far")
        near = both.join(known.select("node", "far"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("far").alias("near"))
        seen = known.join(near, F.col("node") == F.col("a")).select("node", "label", "far", "near")
        moves = seen.select(F.explode(F.array(
            F.struct("node", F.least("far", "near").alias("label"), F.col("label").alias("was")),
            F.struct(F.col("label").alias("node"), F.col("near").alias("label"), F.lit(None).cast("long").alias("was")))).alias("m"))
        labels = moves.groupBy("m.node").agg(F.min("m.label").alias("label"), F.max("m.was").alias("was"))
        labels = materialize(labels, "component-labels")
        if labels.where("was <> label").limit(1).count() == 0:
            return labels.select("node", "label")
