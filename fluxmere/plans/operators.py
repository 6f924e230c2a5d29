"""Operators through USING chains, CSV and SQLite channels, and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import engine_over, query, statement

statement("passthrough_chain", "SELECT r_regionkey, r_name FROM tpch.region USING builtin.passthrough THEN sample.passthrough", "SELECT r_regionkey, r_name FROM region")
statement("row_count", "SELECT * FROM tpch.lineitem USING sample.row_count", "SELECT count(*) AS row_count, cast(11 AS bigint) AS column_count FROM lineitem")
statement("filter_threshold", "SELECT * FROM tpch.part USING filter.threshold WITH column=p_size, threshold=45", "SELECT * FROM part WHERE p_size > 45")
statement("where_then_operator", "SELECT p_brand, p_size FROM tpch.part WHERE p_size > 10 USING filter.threshold WITH column='p_size', threshold=20 THEN sample.row_count", "SELECT count(*) AS row_count, cast(2 AS bigint) AS column_count FROM part WHERE p_size > 20")


@query("SELECT 'l_quantity' AS column_a, 'l_extendedprice' AS column_b, round(corr(l_quantity, l_extendedprice), 8) AS correlation FROM lineitem")
def operator_first_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator stands where SELECT does."""
    found = engine_over(spark, sf_dir).execute("statistic.correlation l_quantity, l_extendedprice FROM tpch.lineitem").df
    return found.withColumn("correlation", F.round("correlation", 8))


_ORDERS = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_totalprice", "double")]


def _stats_oracle() -> str:
    """A row for each column."""
    parts = [f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) AS row_count, count({c}) AS numeric_count, cast(min({c}) AS double) AS min, cast(max({c}) AS double) AS max, round(avg({c}), 6) AS mean FROM orders" for c, t in _ORDERS]
    parts.append("SELECT 'o_orderstatus' AS column_name, 'string' AS data_type, count(*) AS row_count, cast(0 AS bigint) AS numeric_count, 0.0::double AS min, 0.0::double AS max, 0.0::double AS mean FROM orders")
    return " UNION ALL ".join(parts)


@query(_stats_oracle())
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine_over(spark, sf_dir).execute("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM tpch.orders USING sample.column_stats").df
    return found.withColumn("mean", F.round("mean", 6))


def _frames(spark: SparkSession, sf_dir: str, **frames: str):
    """An engine with lazily bound frames."""
    engine = engine_over(spark, sf_dir)
    for name, sql in frames.items():
        engine.frames.bind(name, engine.execute(sql).df)
    return engine


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def concat_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {s: f"SELECT o_orderkey, o_totalprice FROM tpch.orders WHERE o_orderstatus = '{s.upper()}'" for s in "fo"}
    return _frames(spark, sf_dir, **parts).execute("SELECT * FROM dataframe.f, dataframe.o USING builtin.concat").df


@query("SELECT c_custkey, c_name, c_custkey AS c_custkey_1, c_acctbal FROM customer")
def hstack_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _frames(spark, sf_dir, names="SELECT c_custkey, c_name FROM tpch.customer", sums="SELECT c_custkey, c_acctbal FROM tpch.customer")
    return engine.execute("SELECT * FROM dataframe.names, dataframe.sums USING builtin.hstack WITH key=c_custkey").df


_BASIC = "SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev({c}), 4) AS stddev, cast(min({c}) AS double) AS min, cast(max({c}) AS double) AS max FROM lineitem"


@query(" UNION ALL ".join(_BASIC.format(c=c) for c in ("l_quantity", "l_discount")))
def statistic_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine_over(spark, sf_dir).execute("SELECT l_quantity, l_discount FROM tpch.lineitem USING statistic.basic").df
    return found.select("column_name", "n", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), "min", "max")


@query("WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem) SELECT 'l_quantity' AS column_name, cast(CASE WHEN l_quantity = b THEN 7 ELSE least(7, floor((l_quantity - a) / ((b - a) / 7)) + 1) END AS int) AS bucket, count(*) AS n FROM lineitem, e GROUP BY 2")
def statistic_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_over(spark, sf_dir).execute("SELECT l_quantity FROM tpch.lineitem USING statistic.hist WITH bins=7").df.select("column_name", "bucket", "n")


@query("SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 6) AS p_size FROM part")
def zscore_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine_over(spark, sf_dir).execute("SELECT cast(p_partkey AS string) AS key, p_size FROM tpch.part USING transform.normalize").df
    return found.select(F.col("key").cast("bigint").alias("p_partkey"), F.round("p_size", 6).alias("p_size"))


@query(
    "WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT a, sum(n) AS na FROM c GROUP BY 1), k AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1), t AS (SELECT sum(n) AS n FROM c) "
    "SELECT round((SELECT n FROM t) * (sum(c.n * c.n / (na * nb)) - 1), 6) AS statistic, cast(((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM k) - 1) AS int) AS dof FROM c JOIN r USING (a) JOIN k USING (b)"
)
def chisquare(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine_over(spark, sf_dir).execute("SELECT o_orderstatus, o_orderpriority FROM tpch.orders USING explore.chisquare").df
    return found.select(F.round("statistic", 6).alias("statistic"), "dof")


@query("SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 2) AS coefficient FROM lineitem UNION ALL SELECT 'l_quantity' AS term, round(regr_slope(l_extendedprice, l_quantity), 2) AS coefficient FROM lineitem")
def explore_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine_over(spark, sf_dir).execute("SELECT l_quantity, l_extendedprice FROM tpch.lineitem USING explore.regression LABEL l_extendedprice").df
    return found.where("term <> 'r2'").withColumn("coefficient", F.round("coefficient", 2))


@query()
def explore_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_over(spark, sf_dir).execute("SELECT l_quantity, l_extendedprice, l_discount FROM tpch.lineitem USING explore.pca WITH k=2").df


_ANOVA = (
    "SELECT '{c}' AS column_name, round((sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))), 6) AS f_value, count(*) - 1 AS dof_between, cast(sum(n) - count(*) AS bigint) AS dof_within "
    "FROM (SELECT l_returnflag, count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM lineitem GROUP BY 1)"
)


@query(" UNION ALL ".join(_ANOVA.format(c=c) for c in ("l_quantity", "l_discount")))
def explore_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine_over(spark, sf_dir).execute("SELECT l_quantity, l_discount, l_returnflag FROM tpch.lineitem USING explore.anova LABEL l_returnflag").df
    return found.select("column_name", F.round("f_value", 6).alias("f_value"), "dof_between", "dof_within")


@query()
def explore_decisiontree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_over(spark, sf_dir).execute("SELECT l_quantity, l_discount, l_returnflag FROM tpch.lineitem USING explore.decisiontree WITH depth=3 LABEL l_returnflag").df


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment")
def multi_statement_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two statements in a task, the second over what the first wrote."""
    engine = engine_over(spark, sf_dir)
    ident = engine.submit("SELECT c_custkey, c_mktsegment FROM tpch.customer WHERE c_acctbal > 0 INTO dataframe.rich", "SELECT c_mktsegment, count(*) AS n FROM dataframe.rich GROUP BY c_mktsegment INTO dataframe.segments", mode="sync")
    assert engine.tasks.detail(ident)["status"] == "completed"
    return engine.frames.get("segments")


@query("SELECT o.o_orderkey, max(e.event_id) AS event_id FROM orders o JOIN events e ON e.user_id = o.o_custkey AND e.event_id <= o.o_orderkey GROUP BY o.o_orderkey")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the latest event of its customer not after it, by number: one sort of both tables by key, no pairs."""
    from ..functions.joins import asof

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("user"), F.col("o_orderkey").alias("at"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("user"), F.col("event_id").alias("at"), "event_id")
    return asof(orders, events, "user", "at").where("event_id is not null").select("o_orderkey", "event_id")
