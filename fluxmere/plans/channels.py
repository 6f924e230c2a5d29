"""Channels of every kind, made from the tables: SQLite, CSV and other files, frames that persist, Arrow, the catalog and tasks."""

from __future__ import annotations

import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..errors import EngineError
from ..session import shared_folder
from ..sources.registry import from_wire, to_wire
from .catalog import TABLES, engine_over, query, statement


def _folder(spark: SparkSession) -> str:
    """A new folder that the cluster shares."""
    return f"{shared_folder(spark)}/channels-{uuid.uuid4().hex}"


def _file(spark: SparkSession, name: str) -> str:
    """The path of a new file for readers that take one; SQLite and CSV headers are read by path."""
    from pathlib import Path

    folder = _folder(spark).removeprefix("file://").removeprefix("file:")
    Path(folder).mkdir(parents=True, exist_ok=True)
    return f"{folder}/{name}"


def _with_sqlite(spark: SparkSession, sf_dir: str) -> Engine:
    engine = engine_over(spark, sf_dir)
    engine.databases.add("sqlite", "local", path=_file(spark, "x.db"))
    return engine


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 1000 AND s_nationkey IN (1, 2, 3, 4, 5, 6, 7, 8)")
def sqlite_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame into a database table, and back with a projection and filters that the database takes."""
    engine = _with_sqlite(spark, sf_dir)
    engine.execute("SELECT * FROM tpch.supplier INTO sqlite.local.supplier")
    return engine.execute("SELECT s_suppkey, s_name, s_acctbal FROM sqlite.local.supplier WHERE s_acctbal > 1000 AND s_nationkey IN (1, 2, 3, 4, 5, 6, 7, 8)").df


@query("SELECT n_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def sqlite_join_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database table joined with a file table, into a frame."""
    engine = _with_sqlite(spark, sf_dir)
    engine.execute("SELECT * FROM tpch.nation INTO sqlite.local.nation")
    engine.execute("SELECT n.n_name, count(*) AS suppliers FROM tpch.supplier s JOIN sqlite.local.nation n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name INTO dataframe.found")
    return engine.frames.get("found")


@query("SELECT r_regionkey, upper(r_name) AS r_name FROM region WHERE r_regionkey < 4 UNION ALL SELECT 9 AS r_regionkey, 'NEW' AS r_name")
def sqlite_execute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DDL and DML on the database, then its table as a channel."""
    engine = _with_sqlite(spark, sf_dir)
    engine.execute("SELECT cast(r_regionkey AS bigint) AS r_regionkey, r_name FROM tpch.region INTO sqlite.local.region")
    for sql in ("DELETE FROM region WHERE r_regionkey >= 4", "UPDATE region SET r_name = upper(r_name)", "INSERT INTO region VALUES (9, 'NEW')"):
        engine.databases.execute("sqlite", "local", sql)
    return engine.execute("SELECT cast(r_regionkey AS int) AS r_regionkey, r_name FROM sqlite.local.region").df


@query("SELECT 'nation' AS table_name, 'n_nationkey' AS column_name, 'bigint' AS data_type UNION ALL SELECT 'nation', 'n_name', 'string' UNION ALL SELECT 'nation', 'n_regionkey', 'bigint' UNION ALL SELECT 'region', 'r_regionkey', 'bigint' UNION ALL SELECT 'region', 'r_name', 'string'")
def database_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables and columns of a database channel."""
    engine = _with_sqlite(spark, sf_dir)
    for name in ("nation", "region"):
        engine.execute(f"SELECT * FROM tpch.{name} INTO sqlite.local.{name}")
    rows = [(t, c, k) for t in engine.databases.tables("sqlite", "local") for c, k in engine.databases.describe("sqlite", "local", t)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 0")
def csv_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file as a frame, its types found over the whole file."""
    engine = engine_over(spark, sf_dir)
    path = f"{_folder(spark)}/customers"
    engine.execute("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM tpch.customer").df.coalesce(1).write.csv(path, header=True)
    engine.import_csv(path, "customers")
    return engine.execute("SELECT * FROM dataframe.customers WHERE c_acctbal > 0").df


def _files(kind: str, name: str, sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = engine_over(spark, sf_dir)
        path = f"{_folder(spark)}/{kind}"
        spark.read.parquet(f"{sf_dir}/part.parquet").write.format(kind).save(path)
        engine.files(f"{kind}.part", path, kind)
        return engine.execute(sql.replace("FROM part", f"FROM {kind}.part")).df

    run.__name__ = name
    query(sql)(run)


_files("orc", "files_orc", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 25")
_files("json", "files_json", "SELECT p_brand, count(*) AS n FROM part WHERE p_size < 20 GROUP BY p_brand")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def frame_persists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame that another engine over the same folder finds again."""
    folder = _folder(spark)
    first = Engine(spark, folder=folder)
    first.files("tpch.orders", f"{sf_dir}/orders.parquet")
    first.execute("SELECT o_custkey, count(*) AS n FROM tpch.orders GROUP BY o_custkey INTO dataframe.by_customer")
    return Engine(spark, folder=folder).execute("SELECT * FROM dataframe.by_customer").df


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 10 OFFSET 10")
def frame_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir)
    engine.frames.register("nations", engine.execute("SELECT n_nationkey, n_name FROM tpch.nation ORDER BY n_nationkey").df.coalesce(1))
    return engine.preview("dataframe.nations", page=2, page_size=10)


@query("SELECT 'people' AS name, cast(3 AS bigint) AS frame_rows")
def frame_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered, renamed, refused and dropped frames."""
    engine = Engine(spark)
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    engine.frames.register("first", rows)
    engine.frames.register("gone", rows)
    try:
        engine.frames.register("first", rows)
        raise AssertionError("a name was taken twice")
    except EngineError:
        pass
    engine.frames.rename("first", "people")
    engine.frames.unregister("gone")
    return engine.frames.list().select("name", F.col("rows").alias("frame_rows"))


@query(" UNION ALL ".join(f"SELECT 'tpch' AS category, '{t}' AS name, 'table' AS type" for t in TABLES))
def channel_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_over(spark, sf_dir).execute("SELECT * FROM sys.channels").df


@query("SELECT p_partkey, p_size FROM part WHERE p_size = 7")
def channel_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame hides the table of the same last name; its full name still reaches the table."""
    engine = engine_over(spark, sf_dir)
    engine.frames.bind("part", engine.execute("SELECT p_partkey, p_size FROM tpch.part WHERE p_size = 7").df)
    return engine.execute("SELECT p_partkey, p_size FROM part").df


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def arrow_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An Arrow table into a channel, and a channel as Arrow batches."""
    engine = _with_sqlite(spark, sf_dir)
    engine.write_arrow("sqlite.local.nation", pa.Table.from_batches(list(engine.read_arrow("tpch.nation"))))
    found = pa.Table.from_batches(list(engine.read_arrow("sqlite.local.nation", "SELECT cast(n_nationkey AS int) AS n_nationkey, n_name FROM sqlite.local.nation WHERE n_regionkey = 1")))
    return spark.createDataFrame(found)


@query("SELECT r_regionkey, r_name FROM region")
def wire_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_wire(spark, to_wire(engine_over(spark, sf_dir).execute("SELECT * FROM tpch.region").df))


@query("SELECT 400 AS http_status, 'WHERE clause contains forbidden keywords' AS message UNION ALL SELECT 400, 'expected SELECT' UNION ALL SELECT 400, 'SQL too long (max 64KB)' UNION ALL SELECT 404, 'operator not found: no.such' UNION ALL SELECT 409, 'operator is deactivated: builtin.concat'")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the engine says to statements that it doesn't run."""
    engine = engine_over(spark, sf_dir)
    engine.operators.deactivate("builtin.concat")
    asked = ("SELECT * FROM tpch.part WHERE p_size = 1; DELETE FROM part", "DESCRIBE tpch.part", f"SELECT '{'x' * 66_000}' FROM tpch.part", "SELECT * FROM tpch.part USING no.such", "SELECT * FROM tpch.part USING builtin.concat")
    said = [engine.run(sql) for sql in asked]
    return spark.createDataFrame([(x["http_status"], x["error"]) for x in said], "http_status int, message string")


UPLOADED = '''
from fluxmere.operators import OperatorBase, operator
from pyspark.sql import functions as F


@operator("mine", "double", "twice a column")
def double(df, params):
    c = params.get("column", "p_size")
    return df.withColumn(c, F.col(c) * 2)
'''


@query("SELECT p_partkey, p_size * 2 AS p_size FROM part WHERE p_size > 40")
def operator_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operator from Python source: inactive at first, then used in a chain."""
    engine = engine_over(spark, sf_dir)
    (name,) = engine.operators.upload(UPLOADED, "mine")
    assert engine.run(f"SELECT p_partkey, p_size FROM tpch.part USING {name}")["status"] == "failed"
    engine.execute("UPDATE operator SET active = true WHERE category = 'mine' AND name = 'double'")
    return engine.execute(f"SELECT p_partkey, p_size FROM tpch.part WHERE p_size > 40 USING {name} WITH column=p_size THEN builtin.passthrough").df


@query("SELECT * FROM (VALUES ('concat', true), ('hstack', true), ('passthrough', false)) AS t(name, active)")
def operator_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir)
    engine.operators.deactivate("builtin.passthrough")
    return engine.execute("SELECT name, active FROM sys.operators WHERE category = 'builtin'").df


@query("SELECT * FROM (VALUES ('cancelled', 1), ('completed', 3), ('failed', 1)) AS t(status, n)")
def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that complete, fail, and are cancelled before they start, as a channel."""
    engine = engine_over(spark, sf_dir)
    tasks = engine.task_service(workers=1)
    idents = [engine.submit(sql) for sql in ("SELECT count(*) AS n FROM tpch.region USING builtin.passthrough WITH delay_ms=1500", "SELECT * FROM tpch.nation", "SELECT * FROM tpch.nation USING builtin.passthrough WITH force_fail=1", "SELECT * FROM tpch.region", "SELECT * FROM tpch.part")]
    tasks.cancel(idents[-1])
    for ident in idents:
        tasks.wait(ident, 120)
    found = engine.execute("SELECT status, cast(count(*) AS int) AS n FROM sys.tasks GROUP BY status").df
    rows = [tuple(r) for r in found.collect()]
    tasks.close()
    return spark.createDataFrame(rows, "status string, n int")


@query("SELECT k AS channel, cast(k AS bigint) AS n FROM (SELECT unnest(range(8)) AS k)")
def tasks_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight tasks on eight workers, each over a channel of its own into a frame of its own."""
    engine = Engine(spark)
    tasks = engine.task_service(workers=8)
    for k in range(8):
        engine.table(f"t.c{k}", spark.range(k, k + 1).toDF("n"))
    idents = [engine.submit(f"SELECT n FROM t.c{k} INTO dataframe.r{k}") for k in range(8)]
    assert all(tasks.wait(i, 120)["status"] == "completed" for i in idents)
    tasks.close()
    rows = [(k, engine.frames.get(f"r{k}").first().n) for k in range(8)]
    return spark.createDataFrame(rows, "channel bigint, n bigint")


@query("SELECT * FROM (VALUES (0, 'completed', 25, ''), (1, 'completed', 5, 'sample.passthrough')) AS t(step, status, task_rows, chain)")
def task_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir)
    ident = engine.submit("SELECT * FROM tpch.nation INTO dataframe.mid", "SELECT n_regionkey, count(*) AS n FROM dataframe.mid GROUP BY n_regionkey USING sample.passthrough INTO dataframe.out", mode="sync")
    status = engine.tasks.detail(ident)["status"]
    rows = [(d["step"], status, d["sink_rows"], d["chain"]) for d in engine.tasks.diagnostics(ident)]
    return spark.createDataFrame(rows, "step int, status string, task_rows int, chain string")


# Clauses and types that plain statements reach.
statement("filter_boolean", "SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice > 100000 AS big FROM tpch.orders) t WHERE big AND NOT o_orderkey = 1")
statement("filter_bytes", "SELECT n_nationkey FROM tpch.nation WHERE cast(n_name AS binary) > cast('NATION_2' AS binary)", "SELECT n_nationkey FROM nation WHERE encode(n_name) > encode('NATION_2')")
statement("filter_empty", "SELECT r_regionkey, r_name FROM tpch.region WHERE r_regionkey > 1000")
statement("keywords_in_any_case", "sElEcT r_regionkey fRoM tpch.region WhErE r_regionkey > 1 uSiNg builtin.passthrough ThEn sample.passthrough", "SELECT r_regionkey FROM region WHERE r_regionkey > 1")
statement("legacy_with", "SELECT r_regionkey, r_name FROM tpch.region WITH threshold=0.5", "SELECT r_regionkey, r_name FROM region")
statement("agg_approx_distinct", "SELECT l_linestatus, approx_count_distinct(l_returnflag) AS flags FROM tpch.lineitem GROUP BY l_linestatus", "SELECT l_linestatus, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY l_linestatus")
statement("try_casts", "SELECT n_nationkey, try_cast(n_name AS int) AS none, try_cast(substring(n_name, 8) AS int) AS k FROM tpch.nation", "SELECT n_nationkey, TRY_CAST(n_name AS int) AS none, TRY_CAST(substring(n_name, 8) AS int) AS k FROM nation")
statement("map_and_struct", "SELECT p_partkey, element_at(map('size', p_size, 'twice', p_size * 2), 'twice') AS twice, named_struct('a', p_brand, 'b', p_size).b AS size FROM tpch.part", "SELECT p_partkey, p_size * 2 AS twice, p_size AS size FROM part")
statement("json_parsed", "SELECT event_id, from_json(props, 'k INT').k AS k, to_json(named_struct('k', event_id)) AS made FROM tpch.events", "SELECT event_id, cast(json_extract(props, '$.k') AS int) AS k, '{\"k\":' || event_id || '}' AS made FROM events")
statement("variant_path", "SELECT event_id, variant_get(parse_json(props), '$.k', 'int') AS k FROM tpch.events", "SELECT event_id, cast(json_extract(props, '$.k') AS int) AS k FROM events")
statement("granularity_distinct", "SELECT DISTINCT event_type FROM tpch.events GRANULARITY 86400", "SELECT DISTINCT make_timestamp((epoch_us(ts) // 86400000000) * 86400000000) AS time_bucket, event_type FROM events")
statement("granularity_union", "SELECT event_type AS k, count(*) AS n FROM tpch.events GROUP BY event_type UNION ALL SELECT 'all' AS k, count(*) AS n FROM tpch.events GROUP BY 'all' GRANULARITY 86400", "SELECT make_timestamp((epoch_us(ts) // 86400000000) * 86400000000) AS time_bucket, event_type AS k, count(*) AS n FROM events GROUP BY 1, 2 UNION ALL SELECT make_timestamp((epoch_us(ts) // 86400000000) * 86400000000) AS time_bucket, 'all' AS k, count(*) AS n FROM events GROUP BY 1")


@query("SELECT p_brand, max(p_size) + 1 AS above, cast(sum(p_size) AS bigint) AS total FROM part GROUP BY p_brand")
def user_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar function and an aggregate of the user's, over Arrow batches, by name in a statement."""
    @F.pandas_udf("int")
    def above(x: pd.Series) -> pd.Series:
        return x + 1

    @F.pandas_udf("bigint")
    def total(x: pd.Series) -> int:
        return int(x.sum())

    spark.udf.register("fluxmere_above", above)
    spark.udf.register("fluxmere_total", total)
    engine = engine_over(spark, sf_dir)
    engine.frames.bind("sums", engine.execute("SELECT p_brand, fluxmere_total(p_size) AS total FROM tpch.part GROUP BY p_brand").df)
    return engine.execute("SELECT p.p_brand, fluxmere_above(max(p.p_size)) AS above, first(s.total) AS total FROM tpch.part p JOIN dataframe.sums s ON p.p_brand = s.p_brand GROUP BY p.p_brand").df
