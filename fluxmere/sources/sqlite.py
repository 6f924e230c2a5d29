"""SQLite files as a Python data source: partitions by row id, filters pushed into the query."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import BinaryType, BooleanType, ByteType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from ..errors import EngineError

NAME = "fluxmere_sqlite"
#: Parts of a declared type, tried in order, and what they read as; fixed values.
DECLARED = (("INT", LongType()), ("REAL", DoubleType()), ("FLOA", DoubleType()), ("DOUB", DoubleType()), ("NUMERIC", DoubleType()), ("DECIMAL", DoubleType()), ("BOOL", BooleanType()), ("BLOB", BinaryType()))
BATCH = 1000


def quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def type_of(declared: str | None):
    return next((t for part, t in DECLARED if part in (declared or "").upper()), StringType())


def column_type(kind) -> str:
    """The declared type for a column of a frame."""
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return "BIGINT"
    if isinstance(kind, (FloatType, DoubleType)):
        return "REAL"
    return "BLOB" if isinstance(kind, BinaryType) else "BOOLEAN" if isinstance(kind, BooleanType) else "TEXT"


def connect(path: str, readonly: bool = False) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode={'ro' if readonly else 'rwc'}", uri=True, timeout=60)


def schema_of(path: str, table: str) -> StructType:
    with connect(path, True) as db:
        rows = db.execute(f"PRAGMA table_info({quote(table)})").fetchall()
    if not rows:
        raise EngineError(f"table not found: {table}", 404)
    return StructType([StructField(r[1], type_of(r[2])) for r in rows])


@dataclass
class Rows(InputPartition):
    low: int | None
    high: int | None


class SqliteSource(DataSource):
    """Options: path, dbtable, partitions (default 4), readonly."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return schema_of(self.options["path"], self.options["dbtable"])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(self.options, schema, overwrite)


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema: StructType) -> None:
        self.path, self.table, self.n, self.schema = options["path"], options["dbtable"], int(options.get("partitions", "4")), schema
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            column = quote(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            if column and type(f) in signs and isinstance(value, (int, float, str)) and not isinstance(value, bool):
                self.where.append((f"{column} {signs[type(f)]} ?", [value]))
            elif column and isinstance(f, In) and all(isinstance(v, (int, float, str)) and not isinstance(v, bool) for v in value):
                self.where.append((f"{column} IN ({','.join('?' * len(value))})", list(value)))
            elif column and isinstance(f, (IsNull, IsNotNull)):
                self.where.append((f"{column} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL", []))
            else:
                yield f

    def partitions(self) -> list[Rows]:
        """Ranges of the row id; a table without one is read in one piece."""
        with connect(self.path, True) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quote(self.table)}").fetchone()
            except sqlite3.OperationalError:
                low = high = None
        if low is None:
            return [Rows(None, None)]
        step = -(-(high - low + 1) // self.n)
        return [Rows(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        tests, values = [t for t, _ in self.where], [v for _, own in self.where for v in own]
        if partition.low is not None:
            tests.append("rowid BETWEEN ? AND ?")
            values += [partition.low, partition.high]
        columns = ", ".join(quote(f.name) for f in self.schema.fields)
        where = f" WHERE {' AND '.join(tests)}" if tests else ""
        casts = [_cast(f.dataType) for f in self.schema.fields]
        with connect(self.path, True) as db:
            for row in db.execute(f"SELECT {columns} FROM {quote(self.table)}{where}", values):
                yield tuple(None if v is None else c(v) for c, v in zip(casts, row, strict=True))


def _cast(kind):
    """SQLite columns may hold values of any type."""
    if isinstance(kind, BooleanType):
        return lambda v: v.strip().lower() in ("t", "true", "1") if isinstance(v, str) else bool(v)
    if isinstance(kind, LongType):
        return int
    if isinstance(kind, DoubleType):
        return float
    if isinstance(kind, BinaryType):
        return lambda v: v if isinstance(v, bytes) else str(v).encode()
    return lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)


class SqliteWriter(DataSourceWriter):
    """Appends in one transaction a task; the engine sends one task, for the file takes one writer at a time."""

    def __init__(self, options, schema: StructType, overwrite: bool) -> None:
        self.path, self.table, self.schema = options["path"], options["dbtable"], schema
        with connect(self.path) as db:
            if overwrite:
                db.execute(f"DROP TABLE IF EXISTS {quote(self.table)}")
            db.execute(f"CREATE TABLE IF NOT EXISTS {quote(self.table)} ({', '.join(f'{quote(f.name)} {column_type(f.dataType)}' for f in schema.fields)})")

    def write(self, iterator) -> WriterCommitMessage:
        insert = f"INSERT INTO {quote(self.table)} VALUES ({','.join('?' * len(self.schema.fields))})"
        with connect(self.path) as db:
            batch: list[tuple] = []
            for row in iterator:
                batch.append(tuple(v if v is None or isinstance(v, (int, float, str, bytes)) else bytes(v) if isinstance(v, bytearray) else str(v) for v in row))
                if len(batch) >= BATCH:
                    db.executemany(insert, batch)
                    batch = []
            db.executemany(insert, batch)
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        pass


def read(spark: SparkSession, path: str, table: str, **options) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    return spark.read.format(NAME).options(path=path, dbtable=table, **options).load()


def write(df: DataFrame, path: str, table: str) -> None:
    df.sparkSession.dataSource.register(SqliteSource)
    df.coalesce(1).write.format(NAME).mode("append").options(path=path, dbtable=table).save()


def execute(path: str, sql: str) -> int:
    """Runs DDL or DML; rows affected, or -1 where that has no meaning."""
    with connect(path) as db:
        return db.execute(sql).rowcount
