"""Connected components by alternating stars: every round is joins and minima, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import staged


def _larger(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the smallest of its neighbours and itself. Edges point down: a > b."""
    both = edges.union(edges.select("b", "a").toDF("a", "b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _smaller(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all nodes of the links (a, b); component is the smallest node that links reach.

    The rounds end when all edges lead to nodes that have no smaller neighbour and each node has one such edge.
    Links from a node to itself and repeated links change nothing; without links the result is empty.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        # A star forest: no node has two smaller neighbours, and no smaller neighbour has one itself.
        many = edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        chained = edges.join(edges.select(F.col("a").alias("x")), F.col("b") == F.col("x"), "left_semi").select("a")
        if many.union(chained).isEmpty():
            break
        edges = staged(_smaller(_larger(edges)), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component")))
