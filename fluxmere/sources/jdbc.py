"""Relational databases over JDBC: MySQL, PostgreSQL and ClickHouse. The driver's jar must be on the cluster."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Dialect:
    url: str
    port: int
    driver: str
    tables: str
    quote: str = '"'


#: Addresses, ports and catalog queries of the dialects; fixed values.
DIALECTS = {
    "mysql": Dialect("jdbc:mysql://{host}:{port}/{database}", 3306, "com.mysql.cj.jdbc.Driver", "SELECT table_name AS name FROM information_schema.tables WHERE table_schema = '{database}'", "`"),
    "postgres": Dialect("jdbc:postgresql://{host}:{port}/{database}", 5432, "org.postgresql.Driver", "SELECT table_name AS name FROM information_schema.tables WHERE table_schema = '{schema}'"),
    "clickhouse": Dialect("jdbc:clickhouse://{host}:{port}/{database}", 8123, "com.clickhouse.jdbc.ClickHouseDriver", "SELECT name FROM system.tables WHERE database = '{database}'", "`"),
}
FETCH, BATCH = 1024, 1000


def options(kind: str, config: dict) -> dict:
    """Spark's JDBC options of a database channel."""
    dialect = DIALECTS[kind]
    place = {"host": config.get("host", "127.0.0.1"), "port": config.get("port", dialect.port), "database": config.get("database", "default")}
    out = {"url": dialect.url.format(**place), "driver": dialect.driver, "fetchsize": FETCH, "batchsize": BATCH, "pushDownPredicate": "true", "pushDownAggregate": "true", "pushDownLimit": "true"}
    out |= {k: config[k] for k in ("user", "password") if config.get(k)}
    return {k: str(v) for k, v in out.items()}


def read(spark: SparkSession, kind: str, config: dict, table: str) -> DataFrame:
    """A table in parallel where partition_column, lower_bound, upper_bound and partitions are configured."""
    reader = spark.read.format("jdbc").options(**options(kind, config)).option("dbtable", _name(kind, config, table))
    if {"partition_column", "lower_bound", "upper_bound"} <= config.keys():
        reader = reader.options(partitionColumn=config["partition_column"], lowerBound=config["lower_bound"], upperBound=config["upper_bound"], numPartitions=config.get("partitions", 8))
    return reader.load()


def query(spark: SparkSession, kind: str, config: dict, sql: str) -> DataFrame:
    return spark.read.format("jdbc").options(**options(kind, config)).option("query", sql).load()


def write(df: DataFrame, kind: str, config: dict, table: str) -> None:
    """Appends; the table is made if it isn't there."""
    df.write.format("jdbc").options(**options(kind, config)).option("dbtable", _name(kind, config, table)).mode("append").save()


def tables(spark: SparkSession, kind: str, config: dict) -> DataFrame:
    return query(spark, kind, config, DIALECTS[kind].tables.format(database=config.get("database", "default"), schema=config.get("schema", "public")))


def _name(kind: str, config: dict, table: str) -> str:
    q = DIALECTS[kind].quote
    parts = ([config["schema"]] if kind == "postgres" and config.get("schema") else []) + [table]
    return ".".join(q + p.replace(q, q * 2) + q for p in parts)
