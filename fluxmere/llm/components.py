"""Connected components by distributed union-find: star contraction over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written


def _mark(edges: DataFrame) -> tuple:
    """Count and an order-free checksum of an edge table."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of an edge; component is the smallest id that can be reached.

    edges has two columns of a type with an order, neither null. Each round points every vertex at
    the smallest vertex near it, first seen from the larger neighbours, then from the smaller ones,
    until the table stops changing; rounds grow with the logarithm of the longest chain. Only
    minima are gathered for a vertex, never its list of neighbours, so a hub costs no memory; the minima of hubs are written
    before edges are joined with them, which lets adaptive execution split a hub's edges over tasks. Each round is
    written to the shared folder, so a lost executor repeats one round at most.
    """
    a, b = edges.columns
    start = edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    with Scratch(edges.sparkSession) as scratch:
        current = scratch.written(start)
        mark = _mark(current)
        while mark[0]:
            both = current.union(current.select("v", "u"))
            nearest = scratch.written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
            large = current.join(nearest, "u").select(F.col("m").alias("u"), "v").distinct()
            least = large.groupBy("v").agg(F.min("u").alias("m"))
            small = large.join(least, "v").select("m", F.explode(F.array("u", "v")).alias("w")).where("m < w").select(F.col("m").alias("u"), F.col("w").alias("v")).distinct()
            old, current = current, scratch.written(small)
            new = _mark(current)
            scratch.drop(old, nearest)
            if new == mark:
                break
            mark = new
        return written(current.select(F.col("v").alias("id"), F.col("u").alias("component")).union(current.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()))
