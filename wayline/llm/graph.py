"""Connected components by contraction, on Spark tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> id, component: each linked id and the smallest id it reaches.

    Union-find by rounds. Each node takes its smallest neighbour as parent (if smaller); parents' parents are followed
    until all point at roots; links are redrawn between roots, and rounds end when none is left. A round at least
    halves what is still linked. All steps are joins and minima: no node's neighbours are ever gathered.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = cut(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("up")), "parents")
        while True:  # pointer jumping
            above = parents.select(F.col("id").alias("up"), F.col("up").alias("upper"))
            jumped = cut(parents.join(above, "up").select("id", F.col("upper").alias("up"), (F.col("upper") != F.col("up")).alias("moved")), "parents")
            parents, moved = jumped.select("id", "up"), not jumped.filter("moved").isEmpty()
            if not moved:
                break
        if labels is None:
            labels = parents
        else:
            # roots of this round stand for what they had gathered before
            now = parents.select(F.col("id").alias("up"), F.col("up").alias("upper"))
            labels = cut(labels.join(now, "up", "left").select("id", F.coalesce("upper", "up").alias("up")), "labels")
        to = parents.withColumnRenamed("up", "root")
        redrawn = edges.join(to.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(to.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
        edges = cut(redrawn.filter("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "links")
    if labels is None:
        labels = edges.select(F.col("a").alias("id"), F.col("b").alias("up"))
    return labels.select("id", F.col("up").alias("component"))
