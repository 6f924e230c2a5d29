"""Streams over files, with late and repeated rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fluxmere.functions.joins import asof
from fluxmere.streaming import StreamRunner, dedup, interval_join, running_totals, session, tumbling

START = datetime(2024, 1, 1)


@pytest.fixture
def runner(spark, tmp_path):
    rows = [(k % 3, START + timedelta(seconds=20 * k), float(k)) for k in range(30)]
    spark.createDataFrame(rows, "k int, ts timestamp, v double").repartition(3).write.parquet(str(tmp_path / "in"))
    made = StreamRunner(spark, str(tmp_path / "state"))
    made.source = made.files(str(tmp_path / "in"), "k int, ts timestamp, v double")
    made.table = spark.read.parquet(str(tmp_path / "in"))
    return made


def end(runner, name, df, mode="complete"):
    runner.start(name, df, mode=mode).awaitTermination()
    return runner.spark.table(name)


def test_tumbling_like_batch(runner):
    sums = [F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")]
    streamed = end(runner, "tumbling", tumbling(runner.source, 60, ["k"], sums))
    batch = tumbling(runner.table, 60, ["k"], sums)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_session(runner):
    found = end(runner, "sessions", session(runner.source, 61, ["k"], [F.count(F.lit(1)).alias("n")]))
    assert sorted((r.k, r.n) for r in found.collect()) == [(0, 10), (1, 10), (2, 10)]


def test_dedup_and_join(runner):
    assert end(runner, "unique", dedup(runner.source, ["k"]), "append").count() == 3
    joined = end(runner, "joined", interval_join(runner.source, runner.source, "k", 60), "append")
    assert joined.count() == interval_join(runner.table, runner.table, "k", 60).count()


def test_state(runner):
    found = end(runner, "state", running_totals(runner.source, "k", "v"), "update")
    assert {r.k: r.total for r in found.groupBy("k").agg(F.max("total").alias("total")).collect()} == {0: 135.0, 1: 145.0, 2: 155.0}
    assert runner.status()[-1]["name"] == "state"
    runner.stop("state")


def test_complete_and_update_into_files(runner, tmp_path):
    """A batch after the first run replaces complete results and adds to updates; neither is held by the driver."""
    sums = [F.count(F.lit(1)).alias("n")]
    more = runner.spark.createDataFrame([(0, START, 1.0), (1, START, 1.0), (2, START, 1.0)], "k int, ts timestamp, v double")
    made = {"complete": session(runner.source, 61, ["k"], sums), "update": running_totals(runner.source, "k", "v")}
    for again in (False, True):
        if again:
            more.write.mode("append").parquet(str(tmp_path / "in"))
        for mode, df in made.items():
            runner.start(mode, df, sink="parquet", path=str(tmp_path / mode), mode=mode).awaitTermination()
    found = {mode: runner.written(str(tmp_path / mode), df.schema, mode=mode) for mode, df in made.items()}
    assert sorted((r.k, r.n) for r in found["complete"].collect()) == [(0, 11), (1, 11), (2, 11)]
    assert sorted((r.k, r.n) for r in found["update"].collect()) == [(k, n) for k in range(3) for n in (10, 11)]
    assert runner.written(str(tmp_path / "none"), made["complete"].schema).count() == 0


@pytest.mark.parametrize("name", ["stream_session", "stream_state"])
def test_results_of_streams_are_in_files(spark, tmp_path, name):
    from fluxmere.plans import catalog

    rows = [(k, START + timedelta(hours=k), k % 2, "view", 1.0, "{}") for k in range(6)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    found = catalog.QUERIES[name](spark, str(tmp_path))
    assert found.inputFiles()
    assert found.count() == (6 if name == "stream_session" else 2)


def test_asof(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 9, 2), ("b", 1, 3)], "k string, at int, l int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 7, "y"), ("b", 2, "z")], "k string, at int, r string")
    assert sorted(map(tuple, asof(left, right, "k", "at").collect())) == [("a", 5, 1, "x"), ("a", 9, 2, "y"), ("b", 1, 3, None)]
