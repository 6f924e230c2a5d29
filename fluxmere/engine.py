"""The engine: statements of the extended SQL over channels, operators and tasks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from .errors import BAD_REQUEST, INTERNAL, NOT_FOUND, EngineError
from .net import filters as net_filters
from .net import storage as net_storage
from .net.operators import OPERATORS as NET_OPERATORS
from .operators import OperatorCatalog
from .operators import builtin, explore, statistics
from .operators.model import ModelRegistry
from .operators.model import operators as model_operators
from .sources.databases import DatabaseChannels
from .sources.delimited import import_csv
from .sources.pcap import PcapSource
from .sources.registry import FrameRegistry
from .sql import ExtendedQuery, parse
from .sql.desugar import granular, named_channels, time_ranges

#: Texts that users rely on; fixed values.
MULTI_NEEDS_OPERATOR = "multi-source FROM requires USING operator"
MULTI_ONLY_FRAMES = "multi-source FROM only supports dataframe.*"
MULTI_NO_WHERE = "multi-source FROM does not support WHERE"
NO_DATA = "no data to write"
FAILED = "execution failed"

FRAME = "dataframe"
SYSTEM = ("channels", "operators", "tasks", "databases")


@dataclass
class QueryResult:
    """df is the result, lazily for a statement without INTO; rows are counted once asked for or written."""

    df: DataFrame
    result_target: str = ""
    _rows: int | None = None
    chain: list[str] = field(default_factory=list)

    @property
    def rows(self) -> int:
        if self._rows is None:
            self._rows = self.df.count()
        return self._rows


class Engine:
    """folder: where named frames and models are kept, shared by the cluster; without it frames live as long as the session.

    time_column is the column that GRANULARITY counts by.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, database_file: str | None = None, time_column: str = "ts") -> None:
        self.spark, self.time_column = spark, time_column
        self.frames = FrameRegistry(spark, f"{folder.rstrip('/')}/frames" if folder else None)
        self.databases = DatabaseChannels(spark, database_file)
        self.operators = OperatorCatalog()
        for group in (builtin.OPERATORS, statistics.OPERATORS, explore.OPERATORS, NET_OPERATORS, net_storage.OPERATORS, net_filters.OPERATORS):
            self.operators.upsert(group, active=True)
        self.models = ModelRegistry(spark, f"{folder.rstrip('/')}/models") if folder else None
        if self.models:
            self.operators.upsert(model_operators(self.models), active=True)
        self._tables: dict[str, DataFrame] = {}
        self.tasks: Any = None

    # Channels.

    def table(self, name: str, df: DataFrame) -> None:
        """Makes df a source by any name, with or without dots: a static channel."""
        self._tables[name.lower()] = df

    def files(self, name: str, path: str, kind: str = "parquet", **options) -> None:
        """Files as a static channel: parquet, orc, json, csv, text, pcap or any source that the session knows."""
        if kind == "pcap":
            self.spark.dataSource.register(PcapSource)
        self.table(name, self.spark.read.format(kind).options(**options).load(path))

    def import_csv(self, path: str, name: str | None = None) -> dict:
        name, df = import_csv(self.frames, path, name)
        return {"name": name, "rows": df.count(), "schema": df.dtypes}

    def channel(self, name: str) -> DataFrame:
        """Frames, then static channels by full or last name, then database tables; 404 or 400 if there is none."""
        kind, _, rest = name.partition(".")
        if kind.lower() == FRAME and rest in self.frames:
            return self.frames.get(rest)
        if kind.lower() == "sys" and rest.lower() in SYSTEM:
            return self.system(rest.lower())
        if name.lower() in self._tables:
            return self._tables[name.lower()]
        if "." not in name:
            if name in self.frames:
                return self.frames.get(name)
            short = [k for k in self._tables if k.rpartition(".")[2] == name.lower()]
            if len(short) == 1:
                return self._tables[short[0]]
        parts = name.split(".", 2)
        if len(parts) == 3 and (parts[0], parts[1]) in self.databases:
            return self.databases.read(*parts)
        raise EngineError(f"source channel not found: {name}", NOT_FOUND if kind.lower() == FRAME else BAD_REQUEST)

    def system(self, name: str) -> DataFrame:
        if name == "channels":
            rows = [(FRAME, n, "dataframe") for n in self.frames.names()] + [(k.partition(".")[0] if "." in k else "", k.rpartition(".")[2], "table") for k in sorted(self._tables)] + [(c["type"], c["name"], "database") for c in self.databases.list()]
            return self.spark.createDataFrame(rows, "category string, name string, type string")
        if name == "databases":
            return self.spark.createDataFrame([(c["type"], c["name"]) for c in self.databases.list()], "type string, name string")
        if name == "operators":
            rows = [(o["category"], o["name"], o["type"], o["position"], o["description"], o["active"]) for o in self.operators.list()]
            return self.spark.createDataFrame(rows, "category string, name string, type string, position string, description string, active boolean")
        return self.task_service().frame()

    def channels(self) -> DataFrame:
        return self.system("channels")

    def preview(self, name: str, page: int = 1, page_size: int | None = None) -> DataFrame:
        return self.frames.preview(name.removeprefix(f"{FRAME}."), page, page_size)

    # Arrow.

    def read_arrow(self, name: str, sql: str | None = None) -> Iterator[pa.RecordBatch]:
        """A channel, or a statement over it, as Arrow record batches, partition by partition."""
        df = self.execute(sql).df if sql else self.channel(name)
        schema = to_arrow_schema(df.schema)
        as_bytes = df.mapInArrow(_serialized, "batch binary")
        found = False
        for row in as_bytes.toLocalIterator(prefetchPartitions=True):
            with pa.ipc.open_stream(bytes(row.batch)) as stream:
                yield from stream
            found = True
        if not found:
            yield pa.RecordBatch.from_pylist([], schema=schema)

    def write_arrow(self, name: str, table: pa.Table) -> int:
        """An Arrow table into a frame or a database table; how many rows."""
        held = f"arrow_{uuid.uuid4().hex}"
        self.table(f"arrow.{held}", self.spark.createDataFrame(table))
        try:
            return self.execute(f"SELECT * FROM arrow.{held} INTO {name}").rows
        finally:
            del self._tables[f"arrow.{held}"]

    def task_service(self, **options):
        if self.tasks is None:
            from .tasks import TaskService

            self.tasks = TaskService(self, **options)
        return self.tasks

    def submit(self, *sqls: str, **options) -> str:
        return self.task_service().submit(list(sqls), **options)

    # Statements.

    def execute(self, sql: str) -> QueryResult:
        """Runs one statement; raises EngineError. Without INTO the result is lazy, so later operations still reach the scan."""
        managed = self._manage(sql)
        if managed is not None:
            return managed
        query = parse(sql)
        chain = [self.operators.resolve(c.full) for c in query.operators]
        frames = {name: self.channel(name) for name in dict.fromkeys(r.name for r in query.references)}
        self._check(query)
        try:
            df = self._plan(query, frames)
            for k, (call, run) in enumerate(zip(query.operators, chain, strict=True)):
                params = dict(call.params)
                if query.label and "label" not in params:
                    params["label"] = query.label
                df = self._step(run, df if k or not isinstance(df, list) else df, params)
            if isinstance(df, list):
                df = df[0]
            return self._into(query, df)
        except EngineError as e:
            if e.status == INTERNAL and not e.code:
                raise EngineError(e.message, INTERNAL, "OP_EXEC_FAIL", e.stage or "execute") from e
            raise
        except Exception as e:
            raise EngineError(f"{FAILED}: {_short(e)}", INTERNAL, "OP_EXEC_FAIL", "execute") from e

    def run(self, sql: str, limit: int = 100) -> dict:
        """A statement's answer as a dictionary, errors too; data holds the first rows where there is no INTO."""
        try:
            result = self.execute(sql)
            data = None
            if not result.result_target:
                # One row more than is shown tells whether there is anything left to count.
                data = [list(r) for r in result.df.limit(limit + 1).collect()]
                if len(data) <= limit:
                    result._rows = len(data)
                data = data[:limit]
            return {"status": "completed", "rows": result.rows, "result_row_count": result.rows, "result_target": result.result_target, "columns": result.df.columns, "data": data}
        except EngineError as e:
            return {"status": "failed", "error": e.message, "http_status": e.status, "error_code": e.code, "error_stage": e.stage}

    def explain(self, sql: str) -> str:
        df = self.execute(sql).df
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def _check(self, query: ExtendedQuery) -> None:
        if query.dest and not re.fullmatch(r"(?i:dataframe)\.[\w\-]+|[\w\-]+\.[\w\-]+(\.[\w\-]+)?", query.dest):
            raise EngineError(f"invalid INTO destination: {query.dest}, expected dataframe.<name> or <type>.<name>[.<table>]")
        if len(query.sources) > 1:
            if not query.operators:
                # A comma without an operator is a join as in SQL where the body makes use of it.
                if query.is_plain and not query.where:
                    raise EngineError(MULTI_NEEDS_OPERATOR)
                return
            if any(s.partition(".")[0].lower() != FRAME for s in query.sources):
                raise EngineError(MULTI_ONLY_FRAMES)
            if query.where:
                raise EngineError(MULTI_NO_WHERE)

    def _plan(self, query: ExtendedQuery, frames: dict[str, DataFrame]) -> Any:
        """The body as a DataFrame; for an operator over several sources a list of them."""
        if query.operators and len(query.sources) > 1:
            return [frames[s] for s in query.sources]
        # Names of this statement alone: others run beside it, over other channels.
        own = uuid.uuid4().hex
        views = {name: f"_channel_{own}_{k}" for k, name in enumerate(frames)}
        sql = named_channels(query, views.__getitem__)
        if query.granularity:
            sql = granular(sql, query.granularity, self.time_column)
        try:
            for name, view in views.items():
                frames[name].createOrReplaceTempView(view)
            # Names are resolved here; the plan doesn't need the views any more.
            return self.spark.sql(time_ranges(sql))
        finally:
            for view in views.values():
                self.spark.catalog.dropTempView(view)

    def _step(self, run, df: Any, params: dict[str, str]) -> DataFrame:
        try:
            return run(df if isinstance(df, list) else [df], params)
        except EngineError as e:
            raise EngineError(e.message, e.status, e.code or ("OP_EXEC_FAIL" if e.status == INTERNAL else ""), e.stage or run.full) from e
        except Exception as e:
            raise EngineError(f"operator {run.full} execution failed: {_short(e)}", INTERNAL, "OP_EXEC_FAIL", run.full) from e

    def _into(self, query: ExtendedQuery, df: DataFrame) -> QueryResult:
        chain = [c.full for c in query.operators]
        if not query.dest:
            return QueryResult(df, chain=chain)
        kind, _, rest = query.dest.partition(".")
        if kind.lower() == FRAME:
            df = self.frames.register(rest, df, replace=True)
            return QueryResult(df, query.dest, df.count(), chain)
        parts = query.dest.split(".")
        if (parts[0], parts[1]) not in self.databases:
            raise EngineError(f"destination channel not found: {query.dest}", NOT_FOUND)
        if len(parts) < 3:
            raise EngineError(f"destination table is missing: {query.dest}")
        df = df.persist()
        try:
            rows = df.count()
            if not rows:
                raise EngineError(NO_DATA, INTERNAL)
            self.databases.write(df, *parts)
        finally:
            df.unpersist()
        return QueryResult(df, query.dest, rows, chain)

    # Management statements.

    def _manage(self, sql: str) -> QueryResult | None:
        """INSERT INTO channel / operator, UPDATE operator SET active, STOP TASK; None for a query."""
        text = sql.strip().rstrip(";").strip()
        if m := re.fullmatch(r"(?is)insert\s+into\s+(channel|operator)\s*\(([^)]*)\)\s*values\s*\((.*)\)", text):
            keys = [k.strip().lower() for k in m[2].split(",")]
            row = self.spark.sql(f"SELECT {m[3]}").first()
            return self._insert(m[1].lower(), dict(zip(keys, row, strict=True)))
        if m := re.fullmatch(r"(?is)update\s+operator\s+set\s+active\s*=\s*(true|false)\s+where\s+(.*)", text):
            given = {k.lower(): v for k, v in re.findall(r"(?i)(\w+)\s*=\s*'([^']*)'", m[2])}
            category = given.get("catelog") or given.get("category") or given.get("catalog")
            full = f"{category}.{given.get('name')}"
            self.operators.set_active(full, m[1].lower() == "true")
            return self._done("operator", full)
        if m := re.fullmatch(r"(?is)(stop|cancel)\s+task\s+'?([\w\-]+)'?", text):
            self.task_service().cancel(m[2])
            return self._done("task", m[2])
        return None

    def _insert(self, what: str, values: dict) -> QueryResult:
        if what == "channel":
            kind, name = str(values.get("type", "")), str(values.get("name", ""))
            profile = {k.strip(): v.strip() for k, _, v in (p.partition(":") for p in str(values.get("profile", "")).strip("{} ").split(",") if p.strip())}
            if kind.lower() == "ss":
                self.files(f"{kind}.{name}", profile.get("path", ""), profile.get("format", "parquet"))
            else:
                self.databases.add(kind, name, **profile)
            return self._done("channel", f"{kind}.{name}")
        with open(str(values.get("operatorfile", "")), encoding="utf-8") as f:
            for full in (names := self.operators.upload(f.read())):
                self.operators.set_active(full, str(values.get("active", "false")).lower() == "true")
        return self._done("operator", ",".join(names))

    def _done(self, what: str, name: str) -> QueryResult:
        return QueryResult(self.spark.createDataFrame([(what, name)], "kind string, name string"), "", 1)


def _serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as one value in Arrow's stream format."""
    for batch in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as stream:
            stream.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])


def _short(e: Exception) -> str:
    return str(e).strip().split("\n")[0][:500]
