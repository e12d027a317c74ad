"""Connected components of an edge table by alternating star contractions.

Every round groups the edges by node with map-side partial minima and joins
them back; the edge table is checkpointed after each round, so lineage stays
short and a lost executor costs at most one round. Nothing but two totals per
round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdant.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node around it."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.join(least, "a").where("b > a").selectExpr("b AS a", "m AS b").where("a != b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return (edges.join(least, "a").selectExpr("b AS a", "m AS b").union(least.selectExpr("a", "m AS b"))
            .where("a != b").distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long; any direction, loops and repeats allowed) ->
    (node, root) for every node that has an edge to another node; the root is
    the smallest node of its component and is listed with itself."""
    edges = cut(edges.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").where("a != b").distinct())
    seen = None
    while True:
        total = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(total) == seen:
            break
        seen = tuple(total)
        if not total[0]:
            break
        edges = cut(_small_star(_large_star(edges)))
    return edges.selectExpr("a AS node", "b AS root").union(
        edges.selectExpr("b AS node", "b AS root").distinct())
