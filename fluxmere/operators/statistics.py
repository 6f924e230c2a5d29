"""Descriptive statistics and simple transforms."""

from __future__ import annotations

import functools
import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import INTERNAL, EngineError
from .base import Operator, columns_of, is_numeric, number, require

#: Buckets of a histogram when no number is given.
BINS = 10
#: Half the width of a bracket around a quantile, as a share of the rows: three times the error of approximate ones.
BRACKET = 3e-4


def basic(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """A row for each numeric column: column_name, n, mean, stddev, min, q25, median, q75, max; quantiles are approximate within 1/10,000.

    One pass; `columns` narrows them down.
    """
    df = frames[0]
    names = columns_of(df, params)
    if not names:
        raise EngineError("no numeric column", INTERNAL)
    parts = []
    for k, c in enumerate(names):
        x = F.col(f"`{c}`").cast("double")
        parts.append(F.struct(F.lit(c).alias("column_name"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev(x).alias("stddev"), F.min(x).alias("min"), F.percentile_approx(x, [0.25, 0.5, 0.75], 10_000).alias("q"), F.max(x).alias("max")).alias(f"s{k}"))
    rows = df.agg(*parts).select(F.inline(F.array(*(F.col(f"s{k}") for k in range(len(names))))))
    return rows.select("column_name", "n", "mean", "stddev", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "max")


def hist(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """column_name, bucket (from 1), low, high, n: equal widths between min and max of each column; `bins` of them.

    The last bucket holds the maximum. Buckets without rows are left out.
    """
    df = frames[0]
    names, bins = columns_of(df, params), int(number(params, "bins", BINS))
    if not names or bins < 1:
        raise EngineError("hist needs a numeric column and at least one bin", INTERNAL)
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("x")) for c in names))).alias("r")).select("r.*").where("x is not null and not isnan(x)")
    ends = long.groupBy("column_name").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    place = F.when(F.col("a") == F.col("b"), F.lit(1)).otherwise(F.least(F.lit(bins), F.floor((F.col("x") - F.col("a")) / ((F.col("b") - F.col("a")) / bins)) + 1)).cast("int")
    counted = long.join(F.broadcast(ends), "column_name").groupBy("column_name", "a", "b", place.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))  # a row for each column named in the query
    step = (F.col("b") - F.col("a")) / bins
    return counted.select("column_name", "bucket", (F.col("a") + step * (F.col("bucket") - 1)).alias("low"), (F.col("a") + step * F.col("bucket")).alias("high"), "n")


def correlation(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """column_a, column_b, correlation (Pearson) for each pair of columns, one pass."""
    df = frames[0]
    names = columns_of(df, params)
    if len(names) < 2:
        raise EngineError("correlation needs two numeric columns", INTERNAL)
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]
    sums = df.agg(*(F.corr(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias(f"c{k}") for k, (a, b) in enumerate(pairs)))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"c{k}").alias("correlation")) for k, (a, b) in enumerate(pairs)))))


def summary(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """statistic and a string column for each numeric and string column: count, mean, stddev, min, max."""
    return frames[0].summary("count", "mean", "stddev", "min", "max").withColumnRenamed("summary", "statistic")


def threshold(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """Rows whose `column` (the first by default) is over `threshold` (0)."""
    df = frames[0]
    column = require(df, params.get("column") or df.columns[0])
    return df.where(F.col(f"`{column}`") > number(params, "threshold", 0))


def normalize(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """Numeric columns as z-scores by the population's deviation; a column without any becomes 0."""
    df = frames[0]
    names = columns_of(df, params)
    if not names:
        return df
    sums = df.agg(*(f(F.col(f"`{c}`").cast("double")).alias(f"_{n}{k}") for k, c in enumerate(names) for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    place = {c: k for k, c in enumerate(names)}

    def score(c: str):
        k = place[c]
        return F.when(F.col(f"_s{k}") > 0, (F.col(f"`{c}`").cast("double") - F.col(f"_m{k}")) / F.col(f"_s{k}")).when(F.col(f"`{c}`").isNotNull(), F.lit(0.0))

    # One row of sums meets every row: a broadcast of that row.
    return df.join(F.broadcast(sums)).select(*(score(c).alias(c) if c in place else F.col(f"`{c}`") for c in df.columns))


def quantiles(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """column_name, q, value at `probabilities` (0.5,0.9,0.99 by default), semicolon-separated: the least value that q of the rows don't exceed.

    Exact, in two scans: approximate quantiles give a bracket around each one, then only values inside brackets are told
    apart, at most some thousandth of the rows for each q besides equal values, and all others are counted. A frame that
    differs from scan to scan may miss its brackets and then has approximate ones.
    """
    df = frames[0]
    names = columns_of(df, params)
    qs = [float(x) for x in params.get("probabilities", "0.5;0.9;0.99").split(";")]
    # NaN is the greatest value, which approximate quantiles don't know; a bracket that holds infinity holds it too.
    finite = lambda x: F.nanvl(x, F.lit(math.inf))
    columns = [F.col(f"`{c}`").cast("double") for c in names]
    probes = [p for q in qs for p in (max(0.0, q - BRACKET), q, min(1.0, q + BRACKET))]
    near = df.agg(*(F.struct(F.lit(k).alias("k"), F.count(x).alias("n"), F.percentile_approx(finite(x), probes, 10_000).alias("b")).alias(f"c{k}") for k, x in enumerate(columns)))
    near = near.select(F.inline(F.array(*(f"c{k}" for k in range(len(names))))))
    long = df.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), x.alias("x")) for k, x in enumerate(columns)))).alias("r")).select("r.*").where("x is not null")
    low = [F.col("b")[3 * j] if q > BRACKET else F.lit(-math.inf) for j, q in enumerate(qs)]
    high = [F.col("b")[3 * j + 2] if q < 1 - BRACKET else F.lit(math.inf) for j, q in enumerate(qs)]
    y = finite(F.col("x"))
    inside = functools.reduce(Column.__or__, ((a <= y) & (y <= b) for a, b in zip(low, high, strict=True)))
    # Values between brackets come just before the next one; those beyond the last don't matter.
    place = F.when(inside, F.col("x")).otherwise(F.array_min(F.array(*(F.when(a > y, a) for a in low))))
    counted = long.join(F.broadcast(near), "k").groupBy("k", "n", "b", place.alias("at"), inside.alias("inside")).agg(F.count(F.lit(1)).alias("m")).where("at is not null")  # a row for each column named in the query
    summed = counted.withColumn("upto", F.sum("m").over(Window.partitionBy("k").orderBy("at", "inside").rowsBetween(Window.unboundedPreceding, 0)))
    picks = []
    for k in range(len(names)):
        for j, q in enumerate(qs):
            rank = F.greatest(F.lit(1), F.ceil(F.lit(round(Decimal(repr(q)), 18)) * F.col("n").cast("decimal(20,0)")))
            found = F.min(F.when((F.col("k") == k) & (F.col("upto") >= rank), F.struct("at", "inside")))
            picks.append(F.when(found["inside"], found["at"]).otherwise(F.max(F.when(F.col("k") == k, F.col("b")[3 * j + 1]))).alias(f"p{k}_{j}"))
    return summed.agg(*picks).select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(q).alias("q"), F.col(f"p{k}_{j}").alias("value")) for k, c in enumerate(names) for j, q in enumerate(qs)))))


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if is_numeric(t)]


OPERATORS = [
    Operator("statistic", "basic", basic, "count, mean, deviation, quantiles"),
    Operator("statistic", "hist", hist, "histogram of equal widths"),
    Operator("statistic", "correlation", correlation, "Pearson correlation of each pair"),
    Operator("statistic", "quantiles", quantiles, "quantiles"),
    Operator("stats", "summary", summary, "summary in long form"),
    Operator("filter", "threshold", threshold, "rows over a threshold"),
    Operator("transform", "normalize", normalize, "z-scores"),
]
