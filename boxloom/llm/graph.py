"""Connected components over a table of links, by alternating stars (Kiveris et al., 2014). Links never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import Tables, grown


def components(links: DataFrame, tables: Tables | None = None, most_rounds: int = 60) -> DataFrame:
    """links(a, b) in any direction -> (node, component), component the smallest node reachable. Nodes without links are absent.

    Null ends and loops are left out. Each round is two joins by node and is stored, so a hub of millions of links is only
    a skewed join key. Ends when a round changes nothing; rounds grow with the logarithm of the longest path.
    """
    tables = tables or Tables(links.sparkSession)
    edges = tables.stored(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = _mark(edges)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        old, edges = edges, tables.stored(_small(_large(edges)), "links")
        new = _mark(edges)
        tables.drop(old)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node of its neighbourhood."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(grown(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(grown(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()
