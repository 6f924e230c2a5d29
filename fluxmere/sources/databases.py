"""Database channels: their configuration, what is in them, and reading and writing through them."""

from __future__ import annotations

import os
import re
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..errors import BAD_REQUEST, CONFLICT, NOT_FOUND, EngineError
from . import jdbc, sqlite

KINDS = ("sqlite", *jdbc.DIALECTS)
MASK = "****"
PREVIEW = 100


class DatabaseChannels:
    """Channels by type and name; with a file they are kept as YAML.

    Values may hold ${VARIABLE}, expanded when a channel is used: secrets belong there, and only the name is kept.
    A password given in plain is held in memory, never written to the file.
    """

    def __init__(self, spark: SparkSession, file: str | None = None) -> None:
        self.spark, self.file = spark, Path(file) if file else None
        self._channels: dict[tuple[str, str], dict] = {}
        if self.file and self.file.exists():
            for x in yaml.safe_load(self.file.read_text()) or []:
                self._channels[x["type"], x["name"]] = x.get("config", {})

    def _keep(self) -> None:
        if self.file:
            safe = [{"type": t, "name": n, "config": {k: v for k, v in c.items() if k != "password" or re.fullmatch(r"\$\{\w+\}", str(v))}} for (t, n), c in sorted(self._channels.items())]
            self.file.write_text(yaml.safe_dump(safe))

    def add(self, kind: str, name: str, **config) -> None:
        kind = kind.lower()
        if kind not in KINDS:
            raise EngineError(f"unsupported database type: {kind}", BAD_REQUEST)
        if not re.fullmatch(r"[\w\-]+", name):
            raise EngineError(f"bad channel name: {name}", BAD_REQUEST)
        if (kind, name) in self._channels:
            raise EngineError(f"channel already exists: {kind}.{name}", CONFLICT)
        self._channels[kind, name] = config
        self._keep()

    def modify(self, kind: str, name: str, **config) -> None:
        self.config(kind, name)
        self._channels[kind.lower(), name] |= config
        self._keep()

    def remove(self, kind: str, name: str) -> None:
        self.config(kind, name)
        del self._channels[kind.lower(), name]
        self._keep()

    def list(self) -> list[dict]:
        """Channels with their passwords masked."""
        return [{"type": t, "name": n} | {k: MASK if k == "password" else v for k, v in c.items()} for (t, n), c in sorted(self._channels.items())]

    def __contains__(self, key: tuple[str, str]) -> bool:
        return (key[0].lower(), key[1]) in self._channels

    def config(self, kind: str, name: str) -> dict:
        if (kind, name) not in self:
            raise EngineError(f"channel not found: {kind}.{name}", NOT_FOUND)
        expand = lambda v: re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), v) if isinstance(v, str) else v
        return {k: expand(v) for k, v in self._channels[kind.lower(), name].items()}

    # What is in them.

    def tables(self, kind: str, name: str) -> list[str]:
        config = self.config(kind, name)
        if kind.lower() == "sqlite":
            with sqlite.connect(config["path"], True) as db:
                return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        return sorted(r.name for r in jdbc.tables(self.spark, kind.lower(), config).collect())

    def describe(self, kind: str, name: str, table: str) -> list[tuple[str, str]]:
        return self.read(kind, name, table).dtypes

    def preview(self, kind: str, name: str, table: str) -> DataFrame:
        return self.read(kind, name, table).limit(PREVIEW)

    def read(self, kind: str, name: str, table: str) -> DataFrame:
        config = self.config(kind, name)
        if kind.lower() == "sqlite":
            return sqlite.read(self.spark, config["path"], table)
        return jdbc.read(self.spark, kind.lower(), config, table)

    def write(self, df: DataFrame, kind: str, name: str, table: str) -> None:
        """Appends the rows; the table is made if it isn't there."""
        config = self.config(kind, name)
        if str(config.get("readonly", "")).lower() in ("1", "true"):
            raise EngineError(f"channel is read-only: {kind}.{name}", BAD_REQUEST)
        if kind.lower() == "sqlite":
            sqlite.write(df, config["path"], table)
        else:
            jdbc.write(df, kind.lower(), config, table)

    def execute(self, kind: str, name: str, sql: str) -> int:
        """DDL or DML on a SQLite channel; rows affected or -1."""
        if kind.lower() != "sqlite":
            raise EngineError("execute is available for sqlite channels", BAD_REQUEST)
        return sqlite.execute(self.config(kind, name)["path"], sql)
