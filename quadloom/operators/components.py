"""Classes of an equivalence given by pairs: connected components by contraction to stars, in memory of the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.operators.lineage import cut


def equivalence_classes(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, least) for every node of pairs (a, b): the smallest node reachable over pairs in either direction.

    Each round points every node's larger neighbours at its smallest one, then every node's smaller neighbours likewise, so a class
    of n nodes shrinks to a star of n - 1 edges in about log n rounds and never has more edges than it began with. Sums are
    combined before the shuffle; the one join is on the node, which Spark splits where it is hot. Rounds are cut by
    checkpoint(). Nulls and loops are dropped; a table without pairs gives no rows.
    """
    edges = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    before = None
    for _ in range(max_rounds):
        ways = edges.union(edges.select("v", "u"))
        lowest = ways.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = cut(ways.filter("v > u").join(lowest, "u").filter("v > low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lowest, "u").filter("v > low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        edges = cut(small.union(lowest).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            ends = edges.groupBy("u").agg(F.min("v").alias("least")).withColumnRenamed("u", "node")
            return ends.union(edges.select("v", "v").distinct())
        before = state
    raise RuntimeError(f"the classes did not settle in {max_rounds} rounds")
