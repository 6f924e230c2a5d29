"""The task service."""

import time

import pytest

from fluxmere.engine import Engine
from fluxmere.errors import EngineError
from fluxmere.tasks import TaskService


@pytest.fixture
def engine(spark):
    made = Engine(spark)
    made.table("t", spark.range(10).toDF("n"))
    return made


def test_async_sync_and_diagnostics(engine):
    tasks = TaskService(engine)
    ident = tasks.submit("SELECT * FROM t")
    assert tasks.wait(ident)["status"] == "completed"
    two = tasks.submit(["SELECT * FROM t WHERE n > 4 INTO dataframe.mid", "SELECT count(*) AS c FROM dataframe.mid USING builtin.passthrough INTO dataframe.out"], mode="sync")
    assert tasks.detail(two)["rows"] == 1
    assert [(d["source_rows"], d["sink_rows"], d["chain"]) for d in tasks.diagnostics(two)] == [(None, 5, ""), (5, 1, "builtin.passthrough")]
    assert engine.frames.names() == ["out"]  # what was only for the next statement is gone
    assert [e[1] for e in tasks.events(two)] == ["pending", "running", "completed"]


def test_failure_stops(engine):
    tasks = TaskService(engine)
    ident = tasks.submit(["SELECT * FROM t USING builtin.passthrough WITH force_fail=1", "SELECT * FROM t"], mode="sync")
    found = tasks.detail(ident)
    assert (found["status"], found["error_code"], found["error_stage"]) == ("failed", "OP_EXEC_FAIL", "builtin.passthrough")
    assert len(tasks.diagnostics(ident)) == 1


@pytest.mark.parametrize(("sqls", "options"), [([], {}), ([""], {}), (["SELECT 1 FROM t"], {"mode": "x"}), (["SELECT 1 FROM t"], {"timeout_s": -1})])
def test_validation(engine, sqls, options):
    with pytest.raises(EngineError):
        TaskService(engine).submit(sqls, **options)


def test_cancel_and_timeout(engine):
    tasks = TaskService(engine, workers=1)
    slow = "SELECT * FROM t USING builtin.passthrough WITH delay_ms=1500"
    running = tasks.submit([slow, "SELECT * FROM t"])
    waiting = tasks.submit("SELECT * FROM t")
    tasks.cancel(waiting)
    while tasks.detail(running)["status"] == "pending":
        time.sleep(0.05)
    tasks.cancel(running)
    with pytest.raises(EngineError) as e:
        tasks.cancel(running)
    assert e.value.status == 409
    tasks.wait(running), tasks.wait(waiting)
    assert {tasks.detail(x)["status"] for x in (running, waiting)} == {"cancelled"}
    late = tasks.submit([slow, "SELECT * FROM t"], timeout_s=0.3)
    tasks.wait(late)
    assert tasks.detail(late)["status"] == "timeout"
    with pytest.raises(EngineError):
        tasks.detail("none")


def test_list_delete_retention_restart(engine, tmp_path):
    path = str(tmp_path / "tasks.db")
    tasks = TaskService(engine, path, retention_count=2)
    ids = [tasks.submit("SELECT * FROM t", mode="sync") for _ in range(4)]
    assert [x["id"] for x in tasks.list()["items"]] == ids[:1:-1]
    assert tasks.list("failed")["total"] == 0
    tasks.delete(ids[3])
    left = tasks.store.create(["SELECT * FROM t"], "async", 0)
    with pytest.raises(EngineError):
        tasks.delete(left)
    again = TaskService(engine, path)
    assert again.detail(left)["error_code"] == "PROCESS_RESTART"
    engine.tasks = again
    assert engine.execute("SELECT id FROM sys.tasks").df.count() == 2
