"""Joins that Spark has no operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, at: str) -> DataFrame:
    """Each left row with the columns of the last right row of its key whose `at` isn't after its own; nulls if there is none.

    Both sides go through one shuffle by key and one sort; no pair of rows is ever made. Of right rows at
    the same place any one counts. Right columns besides key and at must have names of their own.
    """
    extra = [c for c in right.columns if c not in (key, at)]
    ours = [c for c in left.columns if c not in (key, at)]
    a = left.select(key, at, F.lit(1).alias("_side"), F.struct(*ours).alias("_left"), F.lit(None).cast(right.select(F.struct(*extra)).schema[0].dataType).alias("_right"))
    b = right.select(key, at, F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*ours)).schema[0].dataType).alias("_left"), F.struct(*extra).alias("_right"))
    # At the same place right rows come first.
    order = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.union(b).withColumn("_found", F.last("_right", ignorenulls=True).over(order))
    return both.where("_side = 1").select(key, at, "_left.*", "_found.*")
