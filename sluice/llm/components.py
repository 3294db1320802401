"""Connected components by alternating large-star and small-star steps, all in DataFrames.

A step moves links towards the smallest neighbour; neither gathers a node's neighbours in one place: the
smallest is an aggregate, joined back. Links end as one for each node, to its component's smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import checkpoint


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root) for every node that has a link."""
    edges = checkpoint(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        # large-star: each node's larger neighbours move to its smallest neighbour (itself included)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("_a"), F.least("_m", "a").alias("_m"))
        large = both.join(low, F.col("a") == F.col("_a")).filter("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        # small-star: a node and its smaller neighbours move to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("_m")).withColumnRenamed("a", "_a")
        moved = large.join(low, F.col("a") == F.col("_a"))
        small = moved.select(F.col("b").alias("a"), F.col("_m").alias("b")).union(moved.select("a", F.col("_m").alias("b"))).filter("a != b").distinct()
        edges = checkpoint(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
