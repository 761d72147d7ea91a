"""Connected components as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garbline.session import cut_lineage, remove_path, scratch_mark, scratch_since


def _are_stars(pairs: DataFrame) -> bool:
    """Whether every node of ``pairs`` (``u`` > ``v``, all different) is either a center or bound to one center only."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("bound"), F.lit(0).alias("center")).unionByName(
        pairs.select(F.col("v").alias("node"), F.lit(0).alias("bound"), F.lit(1).alias("center"))
    )
    told = ends.groupBy("node").agg(F.sum("bound").alias("bound"), F.max("center").alias("center"))
    return told.where(F.col("bound") + F.col("center") > 1).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of ``edges`` (``a``, ``b``).

    Alternating stars: each round hooks a node's neighbours to the smallest among them, first
    the larger neighbours, then the smaller ones. Rounds grow with the logarithm of the longest
    path; a node with many neighbours costs one row for each, never a pair of them. The smallest
    neighbours are written before they are joined, so that adaptive execution can split
    the edges of one node. Edges that are stars already take no round. A round's tables are
    deleted when the next one is written.
    """
    spark = edges.sparkSession
    pairs = cut_lineage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    mark = scratch_mark()
    while not _are_stars(pairs):
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = cut_lineage(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), "large"
        )
        # all edges now lead from a larger node to a smaller one
        low = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        pairs = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for path in scratch_since(mark)[:-1]:
            remove_path(spark, path)
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
