"""Connected components as Spark joins, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webkiln.llm.staging import join_hot, stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour or itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"), F.count("*").alias("n")), "low")
    tied = join_hot(both.filter("v > u"), low, ["u"], "n", ["v"])  # a centre may have a third of all edges
    return tied.select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("low"))
    tied = edges.join(low, "u")
    return (
        tied.filter("v <> low")
        .select(F.col("v").alias("u"), F.col("low").alias("v"))
        .unionByName(low.select("u", F.col("low").alias("v")))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that a row (a, b) of ``links`` names.

    The component is its smallest node.  Each round is written to the shared folder;
    the number of rounds grows with the logarithm of the longest chain.  No links
    give no rows; self links and repeated links do no harm.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        edges = stage(_small_star(_large_star(edges)), "star")
        # every round leaves edges to smaller nodes; they are stars once no centre has an edge of its own and no node two
        n, nodes = edges.agg(F.count("*"), F.count_distinct("u")).first()
        if n == nodes and edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
