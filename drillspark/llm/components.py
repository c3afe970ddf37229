"""Classes of linked rows, by passing the smallest label along links until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table


def min_labels(links: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (row long) with the smallest row reachable by ``links`` (a, b long) as ``label``.

    Each step hooks every node's larger neighbours and the node itself to its smallest neighbour, then short-cuts; the
    number of steps is logarithmic in the longest chain. A node's links are never gathered: each step takes minimums
    with a map-side part, joins split a hot node, and links between the same two nodes are kept once.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stage_table(edges, "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low"))
        low = low.select("u", F.least("u", "low").alias("low"))
        # large star: larger neighbours go to the smallest one; small star: so do the node and its smaller neighbours
        star = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        star = stage_table(star, "large-star")
        lowest = star.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n"))
        moved = star.join(lowest.where("n > 1"), "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = stage_table(moved.unionByName(lowest.select("u", F.col("low").alias("v"))).distinct(), "small-star")
        # done when every node has one smaller neighbour, which has none
        higher = edges.groupBy("u").agg(F.count("*").alias("n"))
        ends = edges.select("v").distinct().join(higher, F.col("v") == F.col("u"), "left_semi")
        if higher.where("n > 1").isEmpty() and ends.isEmpty():
            break
    return rows.join(edges.select(F.col("u").alias("row"), "v"), "row", "left").select("row", F.coalesce("v", "row").alias("label"))
