"""Connected components of undirected links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alidade.tables import drop, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the ends of links (a, b): root is the least node that links lead to.

    Every node hangs on a lesser one. A round hangs a node's greater neighbours, then its lesser ones, on the least of
    them, which about halves all paths: rounds grow with the logarithm of the longest path. Each is written in place of
    the one before.
    """
    hung = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    hung, seen = written(hung.distinct(), "links"), None
    while True:
        state = hung.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            named = hung.union(hung.select(F.col("root").alias("node"), "root").distinct())
            return named
        seen = state
        sides = hung.union(hung.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = sides.groupBy("node").agg(F.min("root").alias("least")).select("node", F.least("node", "least").alias("least"))
        up = sides.join(least, "node").where("root > node").select(F.col("root").alias("node"), F.col("least").alias("root")).distinct()
        least = up.groupBy("node").agg(F.min("root").alias("least"))
        down = up.join(least, "node").where("root > least").select(F.col("root").alias("node"), F.col("least").alias("root"))
        before, hung = hung, written(down.union(least.withColumnRenamed("least", "root")).distinct(), "links")
        drop(before)
