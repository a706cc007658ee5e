"""Connected components by alternating large and small stars, in DataFrame rounds that are written out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.sources.staging import staged


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (u, v): the component is its smallest node.

    Rounds grow with the logarithm of the longest path. A hub's neighbours meet its smallest neighbour in a sort-merge join,
    whose large partitions Spark splits. Loops and repeated edges are ignored; nodes without an edge to another are left out.
    """
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        linked = large.join(least.hint("merge"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(linked.union(least.select(F.col("w"), F.col("m"))).where("u <> v").distinct(), "small-star")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
