"""What the operators of this subpackage share: intermediate tables, text batches, words."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are handed to Python code in groups of about so many characters, whatever the Arrow batch holds.
GROUP_CHARS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder's name below spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent (tests on one machine), a temporary folder is set once for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = kept.get() if kept.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='fluxmere-')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Folders that results still read; they go when the program ends.
_LEFT: list[tuple[SparkSession, str]] = []


@atexit.register
def _tidy() -> None:
    for spark, path in _LEFT:
        with contextlib.suppress(Exception):  # the session may have ended already
            delete(spark, path)


class Scratch:
    """Tables of one operator's run: written in the shared folder, all removed when it ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.held: list[tuple[DataFrame | None, str]] = []

    def folder(self) -> str:
        self.held.append((None, shared_dir(self.spark)))
        return self.held[-1][1]

    def written(self, df: DataFrame) -> DataFrame:
        """df as a Parquet table: cuts lineage and survives a lost executor."""
        path = shared_dir(self.spark)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more before the run ends."""
        gone = [path for held, path in self.held if any(held is t for t in tables)]
        for path in gone:
            delete(self.spark, path)
        self.held = [x for x in self.held if x[1] not in gone]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for _table, path in self.held:
            delete(self.spark, path)
        self.held = []


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder that stays until the program ends, for results that go on reading it."""
    path = shared_dir(df.sparkSession)
    _LEFT.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> DataFrame:
    """df, a written table, after letting Spark drop the shuffle files that went into it.

    Spark deletes them once the driver's JVM has found that nothing refers to them, which on an idle heap can take half an hour.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    time.sleep(0.1)
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return what a Python worker has freed to the system: it stays on, idle, beside tasks that need the memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def bounded_batches(df: DataFrame, rows: int = 512) -> DataFrame:
    """df, after seeing to it that Arrow batches of this session hold few rows: whole texts are long, and Spark counts rows, not bytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(df.sparkSession.conf.get(name, "10000"))
    if not 0 < held <= rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def row_key(*columns: str) -> list:
    """Two 64-bit hashes that identify a row by the given columns; null and empty differ."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(1), *parts).alias("key_a"), F.xxhash64(F.lit(2), *parts).alias("key_b")]


def groups_of(texts: list, limit: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about limit characters each; a longer text stands alone."""
    start, held = 0, 0
    for i, x in enumerate(texts):
        n = len(x) if x else 0
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def map_texts(df: DataFrame, id_column: str, text_column: str, made: Callable[[list], dict[str, list]], schema: str, done: Callable[[], None] | None = None) -> DataFrame:
    """Run made over the text column in Arrow batches; the id column and others of df go through unchanged.

    made gets a list of texts (None for null) and returns a list for each new column, named in schema; done is called at
    the end of a partition.
    """
    kept = [c for c in df.columns if c != text_column]
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in kept)
    arrow = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_column)).to_pylist()
            for a, b in groups_of(texts):
                new = made(texts[a:b])
                part = batch.slice(a, b - a)
                columns = {c: part.column(part.schema.get_field_index(c)) for c in kept}
                for name, values in new.items():
                    columns[name] = values if isinstance(values, pa.Array) else pa.array(values, type=arrow[name])
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        if done:
            done()
        give_back()

    full = f"{out_schema}, {schema}"
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    arrow = {f.name: to_arrow_type(f.dataType) for f in _parse_datatype_string(schema).fields}
    return bounded_batches(df).mapInArrow(run, full)


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8; bytes.split() cuts at just these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def size_words(column: str = "text"):
    """Number of words, JVM-side: each word starts where a word character follows a blank or the start."""
    return F.coalesce(F.size(F.filter(F.split(F.col(column), r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")
