"""Connected components of links between ids, as a sequence of contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.session import staged


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node that links reach) for each node of ``links`` (a, b: long).

    In each round every node points to the smallest of itself and its neighbours, in the order of a hash,
    so no chain of ids can be adverse; links then run between the nodes pointed at, and rounds go on until
    no link is left. Each round is written to the shared folder. Links of a node that most others link to
    are reduced before the shuffle.
    """
    edges = staged(links.where("a <> b").select("a", "b").distinct(), "edges")
    place = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("id"))).alias("other"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("id"))
        point = staged(least.select(F.col("a").alias("node"), F.least("other", own)["id"].alias("up")), "points")
        if place is None:
            place = point
        else:
            further = point.selectExpr("node AS up", "up AS top")
            place = staged(place.join(further, "up", "left").selectExpr("node", "coalesce(top, up) AS up"), "places")
        left, right = point.selectExpr("node AS a", "up AS u"), point.selectExpr("node AS b", "up AS v")
        edges = edges.join(left, "a").join(right, "b").where("u <> v")
        edges = staged(edges.selectExpr("least(u, v) AS a", "greatest(u, v) AS b").distinct(), "edges")
    if place is None:
        return links.selectExpr("a AS node", "a AS component").limit(0)
    smallest = place.groupBy("up").agg(F.min("node").alias("component"))
    return place.join(smallest, "up").select("node", "component")
