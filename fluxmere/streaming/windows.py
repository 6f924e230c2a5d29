"""Windowed aggregates for streams and tables alike; late is how long a watermark waits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Watermark where none is given.
LATE = "10 minutes"


def _marked(df: DataFrame, time_column: str, late: str) -> DataFrame:
    """A stream's event time must be an instant, so a time without zone is taken as one in the session's."""
    return df.withColumn(time_column, F.col(time_column).cast("timestamp")).withWatermark(time_column, late) if df.isStreaming else df


def tumbling(df: DataFrame, seconds: int, keys: list[str], aggregates: list[Column], *, time_column: str = "ts", late: str = LATE) -> DataFrame:
    """window_start, window_end, keys and aggregates; this is GROUP BY keys GRANULARITY seconds."""
    return sliding(df, seconds, seconds, keys, aggregates, time_column=time_column, late=late)


def sliding(df: DataFrame, seconds: int, step: int, keys: list[str], aggregates: list[Column], *, time_column: str = "ts", late: str = LATE) -> DataFrame:
    """A row counts in each window of `seconds` that starts every `step` seconds and holds its time."""
    window = F.window(time_column, f"{seconds} seconds", f"{step} seconds").alias("w")
    return _marked(df, time_column, late).groupBy(window, *keys).agg(*aggregates).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *(_name(a) for a in aggregates))


def session(df: DataFrame, gap: int, keys: list[str], aggregates: list[Column], *, time_column: str = "ts", late: str = LATE) -> DataFrame:
    """Stretches of a key without a gap of `gap` seconds; a session ends that long after its last row."""
    window = F.session_window(time_column, f"{gap} seconds").alias("w")
    return _marked(df, time_column, late).groupBy(window, *keys).agg(*aggregates).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, *(_name(a) for a in aggregates))


def _name(aggregate: Column) -> str:
    return aggregate._jc.toString().rpartition(" AS ")[2].strip("`")


def dedup(df: DataFrame, keys: list[str], *, time_column: str = "ts", late: str = LATE) -> DataFrame:
    """One row of each key; in a stream a key is remembered as long as the watermark waits."""
    return _marked(df, time_column, late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def interval_join(left: DataFrame, right: DataFrame, key: str, within: int, *, left_time: str = "ts", right_time: str = "ts", late: str = LATE) -> DataFrame:
    """Pairs of a key whose right row comes at most `within` seconds after the left one; the right columns get the prefix right_."""
    named = right.select(*(F.col(c).alias(f"right_{c}") for c in right.columns))
    a, b = _marked(left, left_time, late), _marked(named, f"right_{right_time}", late)
    after = F.col(f"right_{right_time}")
    return a.join(b, (F.col(key) == F.col(f"right_{key}")) & (after >= F.col(left_time)) & (after <= F.col(left_time) + F.expr(f"interval {int(within)} seconds")))


def running_totals(df: DataFrame, key: str, value: str, *, idle_ms: int = 0) -> DataFrame:
    """(key, n, total) of each key so far, sent on with every batch that has rows of it: state of our own.

    idle_ms drops the state of a key that has had no rows for so long.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b[value].sum())
        state.update((n, total))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    kind = dict(df.dtypes)[key]
    wait = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n bigint, total double", "n bigint, total double", "update", wait)
