"""CSV files as frames, with types inferred over the whole file."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import FrameRegistry


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A header and one record a line. Empty header cells are named col_N; short lines are filled, long ones cut.

    A column of whole numbers is bigint, one of numbers double; anything else, an empty cell or no rows at all make it string.
    Types come from one aggregate over all rows.
    """
    head = spark.read.text(path).first()
    if head is None:
        return spark.createDataFrame([], "col_1 string")
    sample = spark.createDataFrame([(head[0].lstrip("﻿").rstrip("\r"),)], "value string")
    width = len(_cells(spark, sample))
    cells = _cells(spark, sample)
    names, used = [], set()
    for k in range(width):
        name = (cells[k] or "").strip() or f"col_{k + 1}"
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        names.append(name)
    schema = ", ".join(f"`c{k}` string" for k in range(width))
    raw = spark.read.csv(path, schema=schema, header=True, enforceSchema=True, mode="PERMISSIVE", escape='"', quote='"', emptyValue="", nullValue="\u0000", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    raw = raw.select(*(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\r$", "").alias(c) for c in raw.columns))
    whole, number = r"^\s*[+-]?\d+\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    tests = [F.coalesce(F.every(F.col(c).rlike(p) & F.col(c).try_cast(t).isNotNull()), F.lit(False)) for c in raw.columns for p, t in ((whole, "bigint"), (number, "double"))]
    found = raw.agg(*(t.alias(f"t{k}") for k, t in enumerate(tests))).first()
    kinds = ["bigint" if found[2 * k] else "double" if found[2 * k + 1] else "string" for k in range(width)]
    return raw.select(*(F.trim(c).cast(t).alias(n) if t != "string" else F.col(c).alias(n) for c, n, t in zip(raw.columns, names, kinds, strict=True)))


def _cells(spark: SparkSession, sample: DataFrame) -> list[str | None]:
    return list(spark.read.csv(sample.rdd.map(lambda r: r[0]), header=False, inferSchema=False, escape='"', quote='"').first() or [None])


def import_csv(registry: FrameRegistry, path: str, name: str | None = None) -> tuple[str, DataFrame]:
    """Registers a file under its own name; if that is taken, with the time appended. Returns the name and the frame."""
    base = name or re.sub(r"\W+", "_", re.sub(r"\.[^.]*$", "", path.rstrip("/").rpartition("/")[2])) or "frame"
    if base in registry:
        base = f"{base}_{datetime.now():%Y%m%d%H%M%S}"
    return base, registry.register(base, read_csv(registry.spark, path))
