"""Connected components by alternating large and small stars; every step is a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialized


def _starred(edges: DataFrame, centre: str, other: str) -> DataFrame:
    """(centre, other, least): the least of the centre and its neighbours."""
    least = edges.groupBy(centre).agg(F.min(other).alias("m"))
    return edges.join(least, centre).select(F.col(centre).alias("u"), F.col(other).alias("v"), F.least("m", centre).alias("least"))


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node's neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = _starred(both, "a", "b").filter("v > u").select(F.col("v").alias("x"), F.col("least").alias("y"))
    return found.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its neighbours below it are linked to the least of them."""
    found = _starred(edges, "b", "a")
    pairs = found.select(F.explode(F.array(F.struct("u", "least"), F.struct(F.col("v").alias("u"), "least"))).alias("p")).select("p.*")
    return pairs.filter("u <> least").select(F.least("u", "least").alias("a"), F.greatest("u", "least").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that edges (a, b) reach) of every node that isn't the least of its component."""
    edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, seen = materialized(edges, "edges"), None
    while True:
        edges = materialized(_small(_large(edges)), "edges")
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
        seen = mark
