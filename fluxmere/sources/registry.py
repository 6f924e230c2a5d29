"""Named frames of a session."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BAD_REQUEST, CONFLICT, NOT_FOUND, EngineError

#: Rows of a preview, rows of a page when none is asked for, most rows of a page.
PREVIEW, PAGE, MOST = 100, 20, 100


class FrameRegistry:
    """Frames by name, without regard to case. With a folder they are kept as Parquet and found again by the next registry.

    A write replaces the frame only once the new one is complete; a frame that was read before stays readable.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, folder.rstrip("/") if folder else None
        self._frames: dict[str, tuple[str, DataFrame]] = {}
        if self.folder:
            for name, path in self._index().items():
                self._frames[name.lower()] = (name, spark.read.parquet(path))

    # The folder's index is a one-row table, so any store that Spark reaches will do.

    def _index(self) -> dict[str, str]:
        path = f"{self.folder}/_index"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return {}
        row = self.spark.read.text(path).first()
        return json.loads(row[0]) if row else {}

    def _keep_index(self, paths: dict[str, str]) -> None:
        self.spark.createDataFrame([(json.dumps(paths),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/_index")

    def register(self, name: str, df: DataFrame, replace: bool = False) -> DataFrame:
        """Binds name to df, computed once; 409 if the name is taken and replace is False."""
        if not re.fullmatch(r"[\w\-]+", name):
            raise EngineError(f"bad dataframe name: {name}", BAD_REQUEST)
        if not replace and name.lower() in self._frames:
            raise EngineError(f"dataframe already exists: {name}", CONFLICT)
        if self.folder:
            path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            df = self.spark.read.schema(df.schema).parquet(path)
            index = {k: v for k, v in self._index().items() if k.lower() != name.lower()}
            self._keep_index(index | {name: path})
        else:
            df = df.persist()
            df.count()
        self._frames[name.lower()] = (name, df)
        return df

    def bind(self, name: str, df: DataFrame) -> None:
        """Binds name to df as it is, lazily; for tables that are sources of their own."""
        self._frames[name.lower()] = (name, df)

    def __contains__(self, name: str) -> bool:
        return name.lower() in self._frames

    def get(self, name: str) -> DataFrame:
        if name not in self:
            raise EngineError(f"dataframe not found: {name}", NOT_FOUND)
        return self._frames[name.lower()][1]

    def unregister(self, name: str) -> None:
        df = self.get(name)
        if self.folder and (path := {k.lower(): v for k, v in self._index().items()}.get(name.lower())):
            self._keep_index({k: v for k, v in self._index().items() if k.lower() != name.lower()})
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        else:
            df.unpersist()
        del self._frames[name.lower()]

    def rename(self, old: str, new: str) -> None:
        df = self.get(old)
        if new in self:
            raise EngineError(f"dataframe already exists: {new}", CONFLICT)
        del self._frames[old.lower()]
        self._frames[new.lower()] = (new, df)
        if self.folder:
            index = self._index()
            held = next((k for k in index if k.lower() == old.lower()), None)
            if held:
                index[new] = index.pop(held)
                self._keep_index(index)

    def names(self) -> list[str]:
        return sorted(name for name, _ in self._frames.values())

    def list(self) -> DataFrame:
        """(name, rows, schema)."""
        rows = [(name, df.count(), json.dumps([{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields])) for name, df in self._frames.values()]
        return self.spark.createDataFrame(rows, "name string, rows bigint, schema string").orderBy("name")

    def preview(self, name: str, page: int = 1, page_size: int | None = None) -> DataFrame:
        """A page of rows, pages count from 1; without page_size the first 100 rows."""
        df = self.get(name)
        if page_size is None:
            return df.limit(PREVIEW)
        n = min(MOST, page_size if page_size > 0 else PAGE)
        return df.offset((max(1, page) - 1) * n).limit(n)


def schemas_match(a: DataFrame, b: DataFrame) -> bool:
    """Names and types in order; whether nulls are allowed doesn't matter."""
    return [(f.name, f.dataType) for f in a.schema.fields] == [(f.name, f.dataType) for f in b.schema.fields]


def to_wire(df: DataFrame) -> dict:
    """{"columns", "types", "data"} of a small result."""
    rows = [list(r) for r in df.collect()]
    return {"columns": df.columns, "types": [t for _, t in df.dtypes], "data": rows}


def from_wire(spark: SparkSession, wire: dict) -> DataFrame:
    """The frame of such a dictionary; rows of another width are skipped."""
    schema = ", ".join(f"`{c}` {t}" for c, t in zip(wire["columns"], wire["types"], strict=True))
    return spark.createDataFrame([tuple(r) for r in wire["data"] if len(r) == len(wire["columns"])], schema)


def as_epoch(df: DataFrame) -> DataFrame:
    """Timestamps as whole seconds, for consumers that know no timestamps."""
    return df.select(*(F.unix_timestamp(c).alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes))
