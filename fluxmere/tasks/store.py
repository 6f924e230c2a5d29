"""Task records in SQLite on the driver."""

from __future__ import annotations

import json
import sqlite3
import threading
from datetime import UTC, datetime, timedelta

PENDING, RUNNING, COMPLETED, FAILED, CANCELLED, TIMEOUT = "pending", "running", "completed", "failed", "cancelled", "timeout"
#: What a task never leaves again.
TERMINAL = frozenset((COMPLETED, FAILED, CANCELLED, TIMEOUT))
COLUMNS = ("id", "sqls", "status", "mode", "timeout_s", "error", "error_code", "error_stage", "rows", "target", "created", "started", "finished")


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds")


class TaskStore:
    """One connection, one lock: records are few and small."""

    def __init__(self, path: str = ":memory:") -> None:
        self.db = sqlite3.connect(path, check_same_thread=False)
        self.lock = threading.RLock()
        with self.lock, self.db:
            self.db.execute("CREATE TABLE IF NOT EXISTS tasks (seq INTEGER PRIMARY KEY, id TEXT UNIQUE, sqls TEXT, status TEXT, mode TEXT, timeout_s REAL, error TEXT, error_code TEXT, error_stage TEXT, rows INTEGER, target TEXT, created TEXT, started TEXT, finished TEXT)")
            self.db.execute("CREATE TABLE IF NOT EXISTS diagnostics (id TEXT, step INTEGER, sql TEXT, duration_ms INTEGER, source_rows INTEGER, sink_rows INTEGER, chain TEXT, error TEXT)")
            self.db.execute("CREATE TABLE IF NOT EXISTS events (id TEXT, at TEXT, status TEXT, note TEXT)")

    def recover(self) -> int:
        """Tasks that were under way when the process ended have failed."""
        with self.lock:
            ids = [r[0] for r in self.db.execute("SELECT id FROM tasks WHERE status IN (?, ?)", (PENDING, RUNNING))]
            for i in ids:
                self.move(i, FAILED, error="the process was started anew", error_code="PROCESS_RESTART", error_stage="bootstrap")
        return len(ids)

    def create(self, sqls: list[str], mode: str, timeout_s: float) -> str:
        with self.lock, self.db:
            n = self.db.execute("SELECT coalesce(max(seq), 0) + 1 FROM tasks").fetchone()[0]
            ident = f"tsk_{datetime.now(UTC):%Y%m%d%H%M%S}_{n}"
            self.db.execute("INSERT INTO tasks (seq, id, sqls, status, mode, timeout_s, created) VALUES (?, ?, ?, ?, ?, ?, ?)", (n, ident, json.dumps(sqls), PENDING, mode, timeout_s, now()))
            self.db.execute("INSERT INTO events VALUES (?, ?, ?, ?)", (ident, now(), PENDING, ""))
        return ident

    def move(self, ident: str, status: str, **values) -> bool:
        """Sets a status; False if the task has ended already."""
        with self.lock, self.db:
            held = self.db.execute("SELECT status FROM tasks WHERE id = ?", (ident,)).fetchone()
            if held is None or held[0] in TERMINAL:
                return False
            values |= {"status": status} | ({"started": now()} if status == RUNNING else {}) | ({"finished": now()} if status in TERMINAL else {})
            self.db.execute(f"UPDATE tasks SET {', '.join(f'{k} = ?' for k in values)} WHERE id = ?", (*values.values(), ident))
            self.db.execute("INSERT INTO events VALUES (?, ?, ?, ?)", (ident, now(), status, values.get("error") or ""))
        return True

    def get(self, ident: str) -> dict | None:
        with self.lock:
            row = self.db.execute(f"SELECT {', '.join(COLUMNS)} FROM tasks WHERE id = ?", (ident,)).fetchone()
        return dict(zip(COLUMNS, row, strict=True)) | {"sqls": json.loads(row[1])} if row else None

    def list(self, status: str | None, offset: int, limit: int) -> list[dict]:
        with self.lock:
            ids = self.db.execute(f"SELECT id FROM tasks {'WHERE status = ?' if status else ''} ORDER BY seq DESC LIMIT ? OFFSET ?", (*([status] if status else []), limit, offset)).fetchall()
        return [self.get(i) for (i,) in ids]

    def count(self, status: str | None = None) -> int:
        with self.lock:
            return self.db.execute(f"SELECT count(*) FROM tasks {'WHERE status = ?' if status else ''}", [status] if status else []).fetchone()[0]

    def diagnose(self, ident: str, **values) -> None:
        with self.lock, self.db:
            self.db.execute("INSERT INTO diagnostics VALUES (?, ?, ?, ?, ?, ?, ?, ?)", (ident, *(values.get(k) for k in ("step", "sql", "duration_ms", "source_rows", "sink_rows", "chain", "error"))))

    def diagnostics(self, ident: str) -> list[dict]:
        names = ("step", "sql", "duration_ms", "source_rows", "sink_rows", "chain", "error")
        with self.lock:
            return [dict(zip(names, r, strict=True)) for r in self.db.execute(f"SELECT {', '.join(names)} FROM diagnostics WHERE id = ? ORDER BY step", (ident,))]

    def events(self, ident: str) -> list[tuple]:
        with self.lock:
            return self.db.execute("SELECT at, status, note FROM events WHERE id = ? ORDER BY rowid", (ident,)).fetchall()

    def delete(self, ident: str) -> None:
        with self.lock, self.db:
            for t in ("tasks", "diagnostics", "events"):
                self.db.execute(f"DELETE FROM {t} WHERE id = ?", (ident,))

    def retain(self, days: float, most: int) -> int:
        """Drops ended tasks that are older or beyond the newest `most`; 0 stands for no limit."""
        old: set[str] = set()
        with self.lock:
            ended = [r for r in self.db.execute("SELECT id, finished FROM tasks WHERE status IN (?, ?, ?, ?) ORDER BY seq DESC", tuple(TERMINAL))]
        if days:
            limit = (datetime.now(UTC) - timedelta(days=days)).isoformat(timespec="milliseconds")
            old |= {i for i, finished in ended if finished and finished < limit}
        if most:
            old |= {i for i, _ in ended[most:]}
        for i in old:
            self.delete(i)
        return len(old)
