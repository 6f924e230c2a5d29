"""A session with the settings that the engine is made for."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from .errors import INTERNAL, EngineError


def session(app: str = "fluxmere", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution splits skewed joins and merges small partitions; times are UTC. conf names settings with _ for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (settings | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; on one machine, where it isn't set, a temporary one for the session."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    root = held.get() if held.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise EngineError("spark.checkpoint.dir must name a folder that driver and executors share", INTERNAL)
        root = f"file://{tempfile.mkdtemp(prefix='fluxmere-')}"
    if not held.isDefined():
        context.setCheckpointDir(root)
    return root.rstrip("/")
