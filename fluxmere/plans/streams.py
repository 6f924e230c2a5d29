"""Streams over the events table: all of it as one source, read to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..streaming import StreamRunner, dedup, interval_join, running_totals, session, sliding, tumbling
from .catalog import query


def _streamed(spark: SparkSession, sf_dir: str, make, mode: str = "complete") -> DataFrame:
    """make(stream) run to the end of the events, in files of its own: results grow with the events, so the driver doesn't hold them."""
    root = shared_folder(spark)
    name = f"stream_{uuid.uuid4().hex}"
    # A stream's files must be in a folder of their own.
    path = f"{root}/{name}-files"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(path)
    runner = StreamRunner(spark, f"{root}/streams")
    stream = spark.readStream.schema(events.schema).parquet(path)
    made = make(stream)
    runner.start(name, made, sink="parquet", path=f"{root}/{name}-out", mode=mode).awaitTermination()
    return runner.written(f"{root}/{name}-out", made.schema, mode=mode)


@query("SELECT make_timestamp((epoch_us(ts) // 3600000000) * 3600000000) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda s: tumbling(s, 3600, ["event_type"], [F.count(F.lit(1)).alias("n")])).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("SELECT make_timestamp((epoch_us(ts) // 1800000000 - k) * 1800000000) AS window_start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda s: sliding(s, 3600, 1800, [], [F.count(F.lit(1)).alias("n")])).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query("WITH f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM f) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, g")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir, lambda s: session(s, 1800, ["user_id"], [F.count(F.lit(1)).alias("n")])).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


def _appended(spark: SparkSession, sf_dir: str, make, batches: list) -> DataFrame:
    """make(stream) in append mode into Parquet files: the events, then each of batches(events), one micro-batch a file."""
    root, name = shared_folder(spark), f"stream_{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    runner = StreamRunner(spark, f"{root}/streams")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/{name}-files/*")
    for k, part in enumerate([lambda e: e, *batches]):
        part(events).coalesce(1).write.parquet(f"{root}/{name}-files/{k}")
        # A run for each file: what it has seen, and its watermark, stay in the checkpoint.
        runner.start(name, make(stream), sink="parquet", path=f"{root}/{name}-out", mode="append").awaitTermination()
    return spark.read.parquet(f"{root}/{name}-out")


def _later(events: DataFrame) -> DataFrame:
    """One row long after all others, which lets the watermark pass them."""
    return events.orderBy("event_id").limit(1).withColumn("ts", F.col("ts") + F.expr("interval 20 years"))


@query("SELECT make_timestamp((epoch_us(ts) // 3600000000) * 3600000000) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows come out once the watermark has passed them; a second copy of all events, then too late, counts nowhere."""
    made = _appended(spark, sf_dir, lambda s: tumbling(s, 3600, ["event_type"], [F.count(F.lit(1)).alias("n")]), [_later, lambda e: e, lambda e: _later(_later(e))])
    return made.where("window_start < '2040-01-01'").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("SELECT event_id, user_id FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that come twice within the watermark count once."""
    return _appended(spark, sf_dir, lambda s: dedup(s, ["event_id"], late="400 days"), [lambda e: e]).select("event_id", "user_id")


@query("SELECT a.event_id, b.event_id AS right_event_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 600 SECOND")
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream with itself, within ten minutes."""
    return _appended(spark, sf_dir, lambda s: interval_join(s, s, "user_id", 600), []).select("event_id", "right_event_id")


@query("SELECT e.event_id, c.c_name FROM events e JOIN customer c ON e.user_id = c.c_custkey")
def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"), "c_name")
    return _appended(spark, sf_dir, lambda s: s.join(customers, "user_id").select("event_id", "c_name"), [])


@query("SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of our own: totals by key as they were sent last."""
    found = _streamed(spark, sf_dir, lambda s: running_totals(s, "user_id", "value"), "update")
    return found.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("total", "n"), 2).alias("total"))
