"""Statements over frames, tables and databases."""

import pytest

from fluxmere.engine import Engine
from fluxmere.errors import EngineError
from fluxmere.operators import OperatorBase, frame_operator, operator
from fluxmere.operators.base import DEFINED


@pytest.fixture
def engine(spark, tmp_path):
    made = Engine(spark)
    made.databases.add("sqlite", "local", path=str(tmp_path / "x.db"))
    made.databases.execute("sqlite", "local", "CREATE TABLE src (id INTEGER, name TEXT, score REAL)")
    made.databases.execute("sqlite", "local", "INSERT INTO src VALUES (1,'a',10.0),(2,'b',20.0),(3,'c',30.0)")
    return made


def rows(df):
    return sorted(map(tuple, df.collect()))


def failure(engine, sql):
    with pytest.raises(EngineError) as e:
        engine.execute(sql)
    return e.value.status, e.value.message


def test_database_to_frame_and_back(engine):
    assert engine.execute("SELECT * FROM sqlite.local.src INTO dataframe.result").rows == 3
    assert engine.execute("SELECT * FROM dataframe.result INTO sqlite.local.t2").rows == 3
    assert rows(engine.channel("sqlite.local.t2")) == [(1, "a", 10.0), (2, "b", 20.0), (3, "c", 30.0)]
    engine.execute("SELECT * FROM dataframe.result INTO sqlite.local.t2")  # appends
    assert engine.channel("sqlite.local.t2").count() == 6
    assert engine.databases.tables("sqlite", "local") == ["src", "t2"]
    assert engine.databases.describe("sqlite", "local", "src") == [("id", "bigint"), ("name", "string"), ("score", "double")]


def test_into_replaces_only_on_success(engine):
    engine.execute("SELECT * FROM sqlite.local.src INTO dataframe.r")
    held = engine.frames.get("r")
    engine.execute("SELECT * FROM sqlite.local.src WHERE id > 2 INTO dataframe.r")
    assert engine.frames.get("r").count() == 1
    assert held.count() == 3  # a snapshot that was taken before stays
    with pytest.raises(EngineError):
        engine.execute("SELECT * FROM sqlite.local.src USING builtin.passthrough WITH force_fail=1 INTO dataframe.r")
    assert engine.frames.get("r").count() == 1
    assert failure(engine, "SELECT * FROM sqlite.local.src WHERE id > 9 INTO sqlite.local.none") == (500, "no data to write")


def test_anonymous_result_leaves_registry(engine):
    assert engine.run("SELECT * FROM sqlite.local.src")["rows"] == 3
    assert engine.frames.names() == []


def test_errors(engine):
    engine.execute("SELECT * FROM sqlite.local.src INTO dataframe.a")
    engine.execute("SELECT * FROM sqlite.local.src WHERE id = 3 INTO dataframe.b")
    assert failure(engine, "SELECT * FROM dataframe.none") == (404, "source channel not found: dataframe.none")
    assert failure(engine, "SELECT * FROM nowhere.x")[0] == 400
    assert failure(engine, "SELECT * FROM dataframe.a, dataframe.b") == (400, "multi-source FROM requires USING operator")
    assert failure(engine, "SELECT * FROM dataframe.a, sqlite.local.src USING builtin.concat")[1].startswith("multi-source FROM only supports dataframe.*")
    assert failure(engine, "SELECT * FROM dataframe.a, dataframe.b WHERE id > 1 USING builtin.concat")[1].startswith("multi-source FROM does not support WHERE")
    assert failure(engine, "SELECT * FROM dataframe.a INTO t2") == (400, "invalid INTO destination: t2, expected dataframe.<name> or <type>.<name>[.<table>]")
    assert failure(engine, "SELECT * FROM dataframe.a INTO mysql.none.t")[0] == 404
    assert failure(engine, "SELECT * FROM dataframe.a USING no.such") == (404, "operator not found: no.such")
    assert failure(engine, "SELECT missing FROM dataframe.a")[0] == 500


def test_chain_and_states(engine):
    engine.execute("SELECT * FROM sqlite.local.src INTO dataframe.a")
    assert engine.execute("SELECT * FROM dataframe.a USING builtin.passthrough THEN sample.row_count").df.collect()[0] == (3, 3)
    engine.operators.deactivate("builtin.passthrough")
    assert failure(engine, "SELECT * FROM dataframe.a USING builtin.passthrough") == (409, "operator is deactivated: builtin.passthrough")
    engine.operators.activate("BUILTIN.passthrough")
    found = engine.run("SELECT * FROM dataframe.a USING builtin.passthrough THEN builtin.passthrough WITH force_fail=true INTO dataframe.never")
    assert (found["status"], found["error_code"], found["error_stage"]) == ("failed", "OP_EXEC_FAIL", "builtin.passthrough")
    assert "never" not in engine.frames


def test_concat_and_hstack(engine, spark):
    for n, w in (("a", "id < 3"), ("b", "id = 3"), ("c", "id < 3")):
        engine.execute(f"SELECT * FROM sqlite.local.src WHERE {w} INTO dataframe.{n}")
    engine.frames.register("other", spark.createDataFrame([(1,), (2,)], "z int"))
    assert rows(engine.execute("SELECT * FROM dataframe.a, dataframe.b USING builtin.concat").df) == [(1, "a", 10.0), (2, "b", 20.0), (3, "c", 30.0)]
    assert failure(engine, "SELECT * FROM dataframe.a, dataframe.other USING builtin.concat") == (500, "concat schema mismatch at input index 1")
    assert failure(engine, "SELECT * FROM dataframe.a, dataframe.b USING builtin.hstack") == (500, "hstack row count mismatch at input index 1: expected 2, got 1")
    side = engine.execute("SELECT * FROM dataframe.a, dataframe.c, dataframe.other USING builtin.hstack").df
    assert side.columns == ["id", "name", "score", "id_1", "name_1", "score_1", "z"]
    assert rows(side) == [(1, "a", 10.0, 1, "a", 10.0, 1), (2, "b", 20.0, 2, "b", 20.0, 2)]
    # An operator for one frame takes the first.
    assert engine.execute("SELECT * FROM dataframe.b, dataframe.a USING builtin.passthrough").df.collect()[0].id == 3


def test_column_stats(engine, spark):
    engine.table("t", spark.createDataFrame([(1, True, "x", None), (3, False, "y", 2.0)], "i int, b boolean, s string, d double"))
    found = {r.column_name: tuple(r)[1:] for r in engine.execute("SELECT * FROM t USING sample.column_stats").df.collect()}
    assert found == {"i": ("int", 2, 2, 1.0, 3.0, 2.0), "b": ("boolean", 2, 2, 0.0, 1.0, 0.5), "s": ("string", 2, 0, 0.0, 0.0, 0.0), "d": ("double", 2, 1, 2.0, 2.0, 2.0)}


def test_user_operators(engine, spark):
    engine.table("t", spark.createDataFrame([(1, 2.0), (2, 4.0)], "k int, v double"))
    source = '''
from fluxmere.operators import OperatorBase, frame_operator, operator
from pyspark.sql import functions as F

@operator("user", "twice")
def twice(df, params):
    """Twice the column."""
    return df.withColumn(params.get("column", "v"), F.col(params.get("column", "v")) * 2)

@frame_operator("user", "whole")
class Whole(OperatorBase):
    whole_table, schema = True, "rows bigint, top double"
    def work(self, df):
        import pandas as pd
        return pd.DataFrame({"rows": [len(df)], "top": [float(df.v.max()) + float(self.get_config("add", "0"))]})
'''
    assert engine.operators.upload(source) == ["user.twice", "user.whole"]
    assert failure(engine, "SELECT * FROM t USING user.twice")[0] == 409  # new ones are inactive
    engine.operators.activate("user.twice")
    engine.operators.activate("user.whole")
    assert rows(engine.execute("SELECT * FROM t USING user.twice WITH column=v").df) == [(1, 4.0), (2, 8.0)]
    assert rows(engine.execute("SELECT * FROM t USING user.whole WITH add=1").df) == [(2, 5.0)]
    # Parameters of one query aren't seen by the next.
    assert rows(engine.execute("SELECT * FROM t USING user.whole").df) == [(2, 4.0)]
    assert engine.operators.detail("user.twice")["description"] == "Twice the column."
    engine.operators.delete("user.twice")
    assert failure(engine, "SELECT * FROM t USING user.twice")[0] == 404


def test_discovery_isolates_failures(engine, tmp_path):
    (tmp_path / "good.py").write_text("from fluxmere.operators import operator\n@operator('disc', 'ok')\ndef ok(df, params):\n    return df\n")
    (tmp_path / "bad.py").write_text("raise RuntimeError('no')\n")
    (tmp_path / "_skip.py").write_text("raise RuntimeError('never read')\n")
    assert engine.operators.discover(str(tmp_path)) == {"bad.py": "no"}
    engine.operators.activate("disc.ok")
    (tmp_path / "bad.py").unlink()
    assert engine.operators.reload(str(tmp_path)) == {}
    assert engine.operators.detail("disc.ok")["active"]


def test_class_must_derive():
    with pytest.raises(TypeError):
        frame_operator("a", "b")(object)
    DEFINED.found.clear()
    assert issubclass(frame_operator("a", "b")(type("X", (OperatorBase,), {})), OperatorBase)
    assert operator("a", "c")(lambda df, p: df) is not None
    DEFINED.found.clear()


def test_plugins(engine, tmp_path):
    good = tmp_path / "p.py"
    good.write_text("from fluxmere.operators import Operator\nPLUGIN_VERSION = 1\nOPERATORS = [Operator('plug', 'same', lambda frames, params: frames[0])]\n")
    ident = engine.operators.upload_plugin(str(good))
    assert engine.operators.upload_plugin(str(good)) == ident
    assert engine.operators.activate_plugin(ident) == ["plug.same"]
    with pytest.raises(EngineError):
        engine.operators.delete_plugin(ident)
    engine.operators.plugin(ident).running = 1
    with pytest.raises(EngineError, match="in use"):
        engine.operators.deactivate_plugin(ident)
    engine.operators.plugin(ident).running = 0
    engine.operators.deactivate_plugin(ident)
    engine.operators.delete_plugin(ident)
    old = tmp_path / "old.py"
    old.write_text("PLUGIN_VERSION = 0\nOPERATORS = []\n")
    bad = engine.operators.upload_plugin(str(old))
    with pytest.raises(EngineError, match="version"):
        engine.operators.activate_plugin(bad)
    assert "version" in engine.operators.plugin(bad).error


def test_registry(engine, spark, tmp_path):
    folder = f"file://{tmp_path}/kept"
    one = Engine(spark, folder)
    one.frames.register("users", spark.range(250).withColumnRenamed("id", "n"))
    with pytest.raises(EngineError) as e:
        one.frames.register("USERS", spark.range(1))
    assert e.value.status == 409
    assert one.preview("dataframe.users").count() == 100
    assert one.preview("users", 3, 100).count() == 50
    one.frames.rename("users", "people")
    again = Engine(spark, folder)
    assert again.frames.names() == ["people"]
    assert again.frames.get("people").count() == 250
    assert again.frames.list().collect()[0].rows == 250
    again.frames.unregister("people")
    assert Engine(spark, folder).frames.names() == []


@pytest.mark.parametrize(
    ("content", "kinds"),
    [
        ("id,name,score\n1,a,1.5\n2,b,2\n", ["bigint", "string", "double"]),
        ("a,b\n1,x\n,y\n", ["string", "string"]),
        ("a,,b\n1,2,3\n", ["bigint", "bigint", "bigint"]),
        ("only\n", ["string"]),
        ('q,n\n"a ""b"", c",1\n', ["string", "bigint"]),
    ],
)
def test_csv(engine, tmp_path, content, kinds):
    path = tmp_path / "users.csv"
    path.write_text(content)
    found = engine.import_csv(str(path))
    assert [t for _, t in found["schema"]] == kinds
    assert engine.import_csv(str(path))["name"].startswith("users_")
    if '"' in content:
        assert engine.frames.get("users").first()[0] == 'a "b", c'


def test_databases(engine, tmp_path, monkeypatch):
    file = tmp_path / "db.yml"
    kept = Engine(engine.spark, database_file=str(file))
    monkeypatch.setenv("PW", "secret")
    kept.databases.add("mysql", "m", host="h", password="${PW}")
    kept.databases.add("postgres", "p", password="plain")
    assert [c["password"] for c in kept.databases.list()] == ["****", "****"]
    assert "plain" not in file.read_text()
    assert kept.databases.config("mysql", "m")["password"] == "secret"
    with pytest.raises(EngineError):
        kept.databases.add("mysql", "m")
    again = Engine(engine.spark, database_file=str(file))
    assert [c["name"] for c in again.databases.list()] == ["m", "p"]
    again.databases.remove("postgres", "p")
    assert ("postgres", "p") not in again.databases


def test_pushdown(engine):
    plan = engine.channel("sqlite.local.src").where("id > 1")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan
    assert engine.channel("sqlite.local.src").where("id > 1 and name like 'c%'").count() == 1


def test_management(engine, tmp_path):
    engine.execute(f"INSERT INTO channel(type,name,profile) VALUES('sqlite','more','{{path: {tmp_path}/m.db}}')")
    assert ("sqlite", "more") in engine.databases
    engine.execute("UPDATE operator SET active=false WHERE catelog='builtin' AND name='concat'")
    assert not engine.operators.detail("builtin.concat")["active"]
    assert {r.name for r in engine.execute("SELECT name FROM sys.operators WHERE category = 'builtin'").df.collect()} == {"passthrough", "concat", "hstack"}


def test_models(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/e")
    engine.table("t", spark.createDataFrame([(float(k), float(k % 7), "hi" if k > 20 else "lo") for k in range(40)], "x double, y double, kind string"))
    assert engine.execute("SELECT * FROM t USING model.train WITH algorithm=random_forest, name=f, trees=5 LABEL kind").df.first().version == 1
    assert engine.execute("SELECT * FROM t USING model.train WITH algorithm=kmeans, name=g, columns='x,y'").df.first().rows == 40
    assert engine.execute("SELECT x, y FROM t USING model.predict WITH name=f").df.where("prediction = 'hi'").count() > 15
    assert dict(engine.execute("SELECT * FROM t USING model.evaluate WITH name=f").df.collect())["accuracy"] > 0.9
    assert "silhouette" in dict(engine.execute("SELECT * FROM t USING model.evaluate WITH name=g").df.collect())


def test_exploration(spark):
    engine = Engine(spark)
    engine.table("t", spark.createDataFrame([(k % 2, "a" if k % 3 else "b", float(k), 2.0 * k + 1) for k in range(60)], "u int, v string, x double, z double"))
    found = engine.execute("SELECT u, v FROM t USING explore.chisquare").df.first()
    assert found.dof == 1 and found.p_value > 0.9 and not found.significant
    assert "error" in engine.execute("SELECT u FROM t USING explore.chisquare").df.columns
    fit = dict(engine.execute("SELECT x, z FROM t USING explore.regression LABEL z").df.collect())
    assert abs(fit["x"] - 2) < 1e-6 and abs(fit["intercept"] - 1) < 1e-6
    for name in ("logit", "decisiontree"):
        assert engine.execute(f"SELECT x, z, v FROM t USING explore.{name} LABEL v").df.count() > 2
    assert engine.execute("SELECT x, z, v FROM t USING explore.naivebayes LABEL v").df.count() == 60
    assert engine.execute("SELECT x, z FROM t USING explore.pca").df.first().variance > 0.99
    assert engine.execute("SELECT x, z FROM t USING stats.summary").df.count() == 5
    assert engine.execute("SELECT x FROM t USING statistic.quantiles WITH probabilities=0.5").df.first().value in (29.0, 30.0)


def test_statements_at_once(spark):
    """Eight threads, each over a channel of its own: no statement may see another's."""
    from concurrent.futures import ThreadPoolExecutor

    made = Engine(spark)
    for k in range(8):
        made.table(f"t.c{k}", spark.range(k, k + 1).toDF("n"))

    def ask(k):
        return [made.execute(f"SELECT n FROM t.c{k}").df.first().n for _ in range(12)]

    with ThreadPoolExecutor(8) as pool:
        assert list(pool.map(ask, range(8))) == [[k] * 12 for k in range(8)]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("_channel_")]


def test_granularity_of_distinct_rows_and_unions(spark):
    from datetime import datetime

    made = Engine(spark)
    at = [datetime(2024, 1, 1, 0, m) for m in (0, 0, 1)]
    made.table("t.e", spark.createDataFrame([(x, "a") for x in at], "ts timestamp, k string"))
    assert made.execute("SELECT DISTINCT k FROM t.e GRANULARITY 60").df.count() == 2
    assert made.execute("SELECT k, count(*) AS n FROM t.e GROUP BY k UNION ALL SELECT k, max(1) AS n FROM t.e GROUP BY k GRANULARITY 60").df.count() == 4


def test_models_get_partitions_of_a_bounded_size(spark, monkeypatch, tmp_path):
    """However few partitions an input has, models that keep its rows get at most so many of them together, and all of them."""
    from pyspark.ml import Estimator
    from pyspark.sql import functions as F

    from fluxmere.operators import base, explore, model

    monkeypatch.setattr(base, "PART_VALUES", 100 * (1 + base.ROW_VALUES))
    seen = []

    def fit(self, df, params=None):
        seen.append((type(self).__name__, df.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()))
        return Estimator.fit(self, df, params)

    for kind in (model.GBTClassifier, model.KMeans, explore.DecisionTreeClassifier):
        monkeypatch.setattr(kind, "fit", fit)
    engine = Engine(spark, folder=f"file://{tmp_path}")
    engine.table("t", spark.range(2000, numPartitions=1).selectExpr("cast(id % 10 AS double) AS x", "CASE WHEN id % 10 > 6 THEN 'b' ELSE 'a' END AS v"))
    engine.execute("SELECT x, v FROM t USING model.train WITH name=g, algorithm=gbt, trees=2 LABEL v")
    engine.execute("SELECT x FROM t USING model.train WITH name=k, algorithm=kmeans")
    assert dict(engine.execute("SELECT x, v FROM t USING explore.decisiontree LABEL v").df.collect())["accuracy"] == 1
    assert [n for n, _ in seen] == ["GBTClassifier", "KMeans", "DecisionTreeClassifier"]
    assert all(most <= 110 and rows == 2000 for _, (most, rows) in seen)
    assert dict(engine.execute("SELECT x, v FROM t USING model.evaluate WITH name=g").df.collect()) == {"accuracy": 1, "f1": 1}
    assert engine.execute("SELECT x FROM t USING model.predict WITH name=g").df.where("(prediction = 'b') <> (x > 6)").count() == 0
