"""Connected components of a table of links, by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import removed, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of ``links`` (a, b), label being the smallest node of its component.

    Alternates the two star operations on the edges until they no longer change: every node sends its larger neighbours
    to its smallest neighbour, then its smaller ones. The number of rounds grows with the logarithm of the longest path.
    Smallest neighbours are pre-aggregated and joined back, so a node with very many neighbours is not gathered in one task.
    """
    edges = stored(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.union(edges.selectExpr("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = stored(small.where("u != v").distinct())
        # Done when every larger end has one smaller end that is itself nobody's larger end.
        again = small.groupBy("u").count().where("count > 1").select("u").union(small.join(small.selectExpr("u w"), F.col("v") == F.col("w"), "left_semi").select("u"))
        ended = again.isEmpty()
        removed(edges)
        edges = small
        if ended:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
