"""Runs tasks on a pool of threads; Spark jobs of a task carry its id as a tag, so they can be stopped."""

from __future__ import annotations

import threading
import time
from concurrent.futures import Future, ThreadPoolExecutor
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from ..errors import BAD_REQUEST, CONFLICT, NOT_FOUND, EngineError
from . import store as s

if TYPE_CHECKING:
    from ..engine import Engine

MOST_WORKERS, PAGE = 64, 100


class TaskService:
    """workers: 1 to 64. retention_days and retention_count of 0 keep everything."""

    def __init__(self, engine: Engine, path: str = ":memory:", workers: int = 4, retention_days: float = 0, retention_count: int = 0) -> None:
        self.engine, self.store = engine, s.TaskStore(path)
        self.retention_days, self.retention_count = retention_days, retention_count
        self.store.recover()
        self.pool = ThreadPoolExecutor(max(1, min(MOST_WORKERS, workers)), "fluxmere-task")
        self._futures: dict[str, Future] = {}
        self._timers: dict[str, threading.Timer] = {}

    def submit(self, sqls: list[str] | str, mode: str = "async", timeout_s: float = 0) -> str:
        """The task's id; in sync mode the task has ended when this returns."""
        sqls = [sqls] if isinstance(sqls, str) else list(sqls)
        if not sqls or not all(isinstance(x, str) and x.strip() for x in sqls):
            raise EngineError("sql or sqls is required", BAD_REQUEST)
        if mode not in ("async", "sync"):
            raise EngineError("mode must be async or sync", BAD_REQUEST)
        if timeout_s < 0:
            raise EngineError("timeout_s must be >= 0", BAD_REQUEST)
        ident = self.store.create(sqls, mode, timeout_s)
        if mode == "sync":
            self._run(ident, sqls, timeout_s)
        else:
            self._futures[ident] = self.pool.submit(self._run, ident, sqls, timeout_s)
        return ident

    def _run(self, ident: str, sqls: list[str], timeout_s: float) -> None:
        if not self.store.move(ident, s.RUNNING):
            return
        sc = self.engine.spark.sparkContext
        if timeout_s:
            self._timers[ident] = threading.Timer(timeout_s, self._expire, (ident,))
            self._timers[ident].start()
        sc.addJobTag(ident)
        made: list[str] = []
        rows, target = None, ""
        try:
            for step, sql in enumerate(sqls):
                if self.store.get(ident)["status"] != s.RUNNING:
                    return
                began = time.monotonic()
                try:
                    result = self.engine.execute(sql)
                    found = result.rows
                except EngineError as e:
                    self.store.diagnose(ident, step=step, sql=sql, duration_ms=int((time.monotonic() - began) * 1000), source_rows=rows, error=e.message)
                    self.store.move(ident, s.FAILED, error=e.message, error_code=e.code or "SQL_ERROR", error_stage=e.stage or "execute")
                    return
                self.store.diagnose(ident, step=step, sql=sql, duration_ms=int((time.monotonic() - began) * 1000), source_rows=rows, sink_rows=found, chain="->".join(result.chain))
                rows, target = found, result.result_target
                if step < len(sqls) - 1 and target.lower().startswith("dataframe."):
                    made.append(target.partition(".")[2])
            self.store.move(ident, s.COMPLETED, rows=rows, target=target)
        except Exception as e:
            self.store.move(ident, s.FAILED, error=str(e).split("\n")[0][:500], error_code="INTERNAL", error_stage="execute")
        finally:
            sc.removeJobTag(ident)
            if timer := self._timers.pop(ident, None):
                timer.cancel()
            # What the statements before the last one wrote for each other isn't kept.
            last = target.partition(".")[2].lower()
            for name in dict.fromkeys(made):
                if name in self.engine.frames and name.lower() != last:
                    self.engine.frames.unregister(name)
            self.store.retain(self.retention_days, self.retention_count)

    def _expire(self, ident: str) -> None:
        if self.store.move(ident, s.TIMEOUT, error="task timeout", error_code="TIMEOUT", error_stage="execute"):
            self.engine.spark.sparkContext.cancelJobsWithTag(ident)

    def cancel(self, ident: str) -> None:
        """404 for an unknown task, 409 for one that has ended; a running statement is stopped."""
        self.detail(ident)
        if not self.store.move(ident, s.CANCELLED, error="cancelled"):
            raise EngineError(f"task has ended: {ident}", CONFLICT)
        self.engine.spark.sparkContext.cancelJobsWithTag(ident)

    def wait(self, ident: str, timeout: float | None = None) -> dict:
        if future := self._futures.get(ident):
            future.result(timeout)
        return self.detail(ident)

    def detail(self, ident: str) -> dict:
        found = self.store.get(ident)
        if not found:
            raise EngineError(f"task not found: {ident}", NOT_FOUND)
        return found

    def diagnostics(self, ident: str) -> list[dict]:
        self.detail(ident)
        return self.store.diagnostics(ident)

    def events(self, ident: str) -> list[tuple]:
        return self.store.events(ident)

    def list(self, status: str | None = None, page: int = 1, page_size: int = 20) -> dict:
        n = max(1, min(PAGE, page_size))
        return {"total": self.store.count(status), "page": page, "items": self.store.list(status, (max(1, page) - 1) * n, n)}

    def delete(self, ident: str) -> None:
        if self.detail(ident)["status"] not in s.TERMINAL:
            raise EngineError(f"task is under way: {ident}", CONFLICT)
        self.store.delete(ident)

    def frame(self) -> DataFrame:
        """All tasks as rows, the newest first."""
        names = [c for c in s.COLUMNS if c != "sqls"]
        rows = [tuple(None if x[c] is None else str(x[c]) for c in names) for x in self.store.list(None, 0, 1 << 30)]
        return self.engine.spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names))

    def close(self) -> None:
        self.pool.shutdown(wait=True, cancel_futures=True)
