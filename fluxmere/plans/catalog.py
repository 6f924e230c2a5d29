"""The registry of named queries: statements of the extended SQL, operators and network queries, with DuckDB SQL where that can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def engine_over(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine whose static channels are the tables of a folder; nothing is read until a query asks for it."""
    engine = Engine(spark)
    for name in TABLES:
        engine.table(f"tpch.{name}", spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return engine


def statement(name: str, sql: str, oracle: str | None = None) -> None:
    """A query given as extended SQL; the oracle is the same text unless another is given."""
    QUERIES[name] = lambda spark, sf_dir: engine_over(spark, sf_dir).execute(sql).df
    ORACLES[name] = oracle or sql.replace("tpch.", "")


def query(oracle: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its own name."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return wrap


FLAGSHIP = (
    "SELECT c.c_mktsegment, count(*) AS orders, cast(sum(cast(o.o_totalprice AS decimal(18,2))) AS double) AS revenue FROM tpch.orders o JOIN tpch.customer c ON o.o_custkey = c.c_custkey "
    "WHERE o.o_orderdate = '[1995/01/01 00:00:00 - 1996/12/31 23:59:59]' GROUP BY c.c_mktsegment GRANULARITY 2592000 USING builtin.passthrough"
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and revenue by segment and 30-day bucket through an operator chain."""
    engine = engine_over(spark, sf_dir)
    engine.time_column = "o.o_orderdate"
    return engine.execute(FLAGSHIP).df


QUERIES["flagship_segment_granularity"] = flagship
ORACLES["flagship_segment_granularity"] = (
    "SELECT make_timestamp((epoch_us(o_orderdate) // 2592000000000) * 2592000000000) AS time_bucket, c_mktsegment, count(*) AS orders, cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) AS revenue "
    "FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= timestamp '1995-01-01 00:00:00' AND o_orderdate <= timestamp '1996-12-31 23:59:59' GROUP BY 1, 2"
)

from . import channels, models, network, operators, relational, streams  # noqa: E402, F401  they register themselves
