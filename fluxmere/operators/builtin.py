"""Row-wise and column-wise union, passing through, and counting."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import INTERNAL, EngineError
from ..session import shared_folder
from ..sources.registry import schemas_match
from .base import Operator, flag, is_numeric, require

#: Longest wait that passthrough takes, in milliseconds.
MOST_DELAY = 60_000


def passthrough(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """Its input; delay_ms waits on the driver first, force_fail fails."""
    if flag(params.get("force_fail")):
        raise EngineError("passthrough forced failure", INTERNAL)
    delay = params.get("delay_ms", "0")
    if delay.isdigit() and int(delay) <= MOST_DELAY:
        time.sleep(int(delay) / 1000)
    return frames[0]


def concat(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """All rows of all inputs, duplicates too; names and types must match in order."""
    if len(frames) < 2:
        raise EngineError("concat requires at least 2 inputs", INTERNAL)
    for k, x in enumerate(frames[1:], 1):
        if not schemas_match(frames[0], x):
            raise EngineError(f"concat schema mismatch at input index {k}", INTERNAL)
    return reduce(DataFrame.union, frames)


def hstack(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """Columns side by side, row by row in the order of `key` (a column of every input), else in the inputs' own order.

    Rows are numbered partition by partition from the counts of the partitions before, in the JVM, so nothing is
    gathered in one place, and meet by their number. The inputs' own order is that of their scans: it is only defined where
    these read the same files in the same way each time, so tables that matter should name a key. Columns of the same name get the input's number appended.
    """
    if len(frames) < 2:
        raise EngineError("hstack requires at least 2 inputs", INTERNAL)
    counts = [x.count() for x in frames]
    for k, n in enumerate(counts[1:], 1):
        if n != counts[0]:
            raise EngineError(f"hstack row count mismatch at input index {k}: expected {counts[0]}, got {n}", INTERNAL)
    used: set[str] = set()
    out = None
    for k, x in enumerate(frames):
        names = []
        for c in x.columns:
            name = c if c.lower() not in used else f"{c}_{k}"
            while name.lower() in used:
                name += "_"
            used.add(name.lower())
            names.append(name)
        numbered_rows = numbered(x.orderBy(require(x, params["key"])) if params.get("key") else x, "_row").toDF(*names, "_row")
        out = numbered_rows if out is None else out.join(numbered_rows, "_row")
    return out.drop("_row")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a column that counts its rows from 0, in their order: without a sort that of the scan.

    The rows are checkpointed with their place in their partition, so a lost executor can't number them anew; the
    partitions' sizes, a row each, give where each of them starts.
    """
    shared_folder(df.sparkSession)
    kept = df.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}).checkpoint()
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    # The low bits of the id are the place in the partition.
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(F.broadcast(starts), "_part").select(*(F.col(f"`{c}`") for c in df.columns), place.alias(name))  # a row for each partition


def row_count(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """row_count and column_count."""
    return frames[0].agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(frames[0].columns)).cast("bigint"))


def column_stats(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """A row for each column: column_name, data_type, row_count, numeric_count, min, max, mean; one pass over the input.

    Booleans count as 0 and 1. Nulls are left out of numeric_count and the statistics; a column that isn't
    numeric, or has no value, has 0 for all of them.
    """
    df = frames[0]
    numeric = {c: F.col(f"`{c}`").cast("double") for c, t in df.dtypes if is_numeric(t) or t == "boolean"}
    parts: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for k, (c, x) in enumerate(numeric.items()):
        parts += [F.count(x).alias(f"n{k}"), F.min(x).alias(f"a{k}"), F.max(x).alias(f"b{k}"), F.avg(x).alias(f"m{k}")]
    place = {c: k for k, c in enumerate(numeric)}
    zero = F.lit(0.0)

    def row(c: str, kind: str) -> Column:
        k = place.get(c)
        values = [F.coalesce(F.col(f"{x}{k}"), zero) for x in "abm"] if k is not None else [zero] * 3
        count = F.col(f"n{k}") if k is not None else F.lit(0).cast("bigint")
        named = zip(("min", "max", "mean"), values, strict=True)
        return F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("data_type"), F.col("rows").alias("row_count"), count.alias("numeric_count"), *(v.alias(n) for n, v in named))

    return df.agg(*parts).select(F.inline(F.array(*(row(c, t) for c, t in df.dtypes))))


OPERATORS = [
    Operator("builtin", "passthrough", passthrough, "its input"),
    Operator("builtin", "concat", concat, "rows of all inputs", multi=True),
    Operator("builtin", "hstack", hstack, "columns of all inputs", multi=True),
    Operator("sample", "passthrough", lambda frames, params: frames[0], "its input"),
    Operator("sample", "row_count", row_count, "rows and columns"),
    Operator("sample", "column_stats", column_stats, "count, min, max and mean of each column"),
]
