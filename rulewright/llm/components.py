"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.shared import temporary_tables, written


def _star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """(v, smallest) for each edge (u, v) with u's smallest neighbour.

    ``least`` is a written table, so both sides of the join are plain exchanges and Spark splits the
    partition of a node with very many edges.
    """
    joined = edges.join(written(least, "least"), "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _are_stars(e: DataFrame) -> bool:
    """Whether each u has one edge and no v is a u; edges have u > v."""
    nodes = e.groupBy("u").agg(F.count("*").alias("n"))
    if not nodes.where("n > 1").isEmpty():
        return False
    return e.select("v").distinct().join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); a component's name is its smallest node.

    Loops, repeated and null edges do no harm. Each step is written to the shared folder; the driver gets two numbers.
    The result is a written table, the steps' tables are deleted.
    The steps end when the edges are stars: every node has one edge and no centre is a node of another star. The
    number of rounds grows with the logarithm of the longest path.
    """
    with temporary_tables():
        e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        e = written(e, "edges")
        while not _are_stars(e):
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            # large star: larger neighbours go to the smallest of the neighbourhood
            large = written(_star(both.where("v > u"), least).distinct(), "large-star")
            # small star: the node and its smaller neighbours go to the smallest of them
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            e = written(_star(large, least).unionByName(large.groupBy("u").agg(F.min("v").alias("v"))).distinct(), "small-star")
        roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        parts = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        return written(parts, "components", keep=True)
