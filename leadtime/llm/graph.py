"""Connected components of a table of links, by DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component: the smallest node that each node of ``links`` (columns a, b) is connected with.

    Alternating stars: each node hands its neighbours to the smallest one of them (larger neighbours first, then
    smaller ones), until links point straight to the smallest node of their component. The rounds grow with
    the logarithm of the size of a component, and links are never more than at the start.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        # Large star: larger neighbours of a node point to the smallest of its neighbourhood.
        large = both.where("b > a").join(near, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a > b").distinct()
        large = stage(large, "large")
        # Small star: smaller neighbours of a node, and itself, point to the smallest of them.
        down = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(down.select("a", F.col("least").alias("b")))
        new = stage(small.where("a > b").distinct(), "edges")
        # At the end each node has one link, and what it points to has none.
        unsettled = new.groupBy("a").count().where("count > 1").select("a").unionByName(new.select("a").join(new.select(F.col("b").alias("a")), "a", "left_semi").select("a"))
        edges = new
        if unsettled.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
