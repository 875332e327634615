"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.steps import settled


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for each node of ``edges``; the component is its least node.

    Loops, repeated edges and edges with a null end change nothing. Each step joins every edge with
    the least neighbour of one of its ends: a minimum that is combined in the map tasks, and a join
    whose hot node adaptive execution splits on the edges' side. The steps go on until nothing
    changes; each one is written to the shared scratch folder, so no lineage grows and nothing is
    collected but two sums.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = settled(
        now.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    )
    before = None
    while not now.isEmpty():
        stars = _small_star(_large_star(now))
        now = settled(stars)
        mark = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if mark == before:
            break
        before = mark
    leaves = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return leaves.withColumnRenamed("u", "node").unionByName(roots).groupBy("node").agg(
        F.min("component").alias("component")
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to its least neighbour, itself included."""
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.join(least, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of each node, and itself, to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(kept).where(F.col("u") != F.col("v")).distinct()
