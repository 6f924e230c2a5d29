"""Starting, watching and stopping streaming queries by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..errors import CONFLICT, NOT_FOUND, EngineError

#: Settings of a query's state: in RocksDB, whose memory an executor bounds for all its states together.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


class StreamRunner:
    """checkpoint: a folder that the cluster shares; a query of the same name goes on where it stopped."""

    def __init__(self, spark: SparkSession, checkpoint: str) -> None:
        self.spark, self.checkpoint = spark, checkpoint.rstrip("/")
        self._queries: dict[str, StreamingQuery] = {}

    def files(self, path: str, schema: str, kind: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
        reader = self.spark.readStream.schema(schema).format(kind)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        return reader.load(path)

    def kafka(self, servers: str, topic: str, **options) -> DataFrame:
        """A topic's records; the connector's jar must be on the cluster."""
        return self.spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()

    def start(self, name: str, df: DataFrame, *, sink: str = "memory", path: str | None = None, mode: str = "append", once: bool = True, every: str | None = None) -> StreamingQuery:
        """once: all that is there now, then the end; else batches every so often. Sinks: memory (a table of that name, which the driver holds) or a file format with a path.

        In a mode other than append each batch has a folder of its own under the path; `written` reads them.
        """
        held = self._queries.get(name)
        if held is not None and held.isActive:
            raise EngineError(f"stream is running: {name}", CONFLICT)
        writer = df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{self.checkpoint}/{name}")
        if path and mode != "append":
            writer = writer.foreachBatch(self._batches(path, sink, mode))
        else:
            writer = writer.format(sink)
            if path:
                writer = writer.option("path", path)
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every or "1 second")
        # A query takes its settings when it starts: its state is on executors' disks with a bounded cache, not in their heaps.
        before = {k: self.spark.conf.get(k, None) for k in STATE}
        try:
            for k, v in STATE.items():
                self.spark.conf.set(k, v)
            self._queries[name] = writer.start()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        return self._queries[name]

    def _batches(self, path: str, sink: str, mode: str):
        """Writes a batch; a batch that comes again takes the place of its first attempt. Complete batches are kept for one batch more."""

        def write(batch: DataFrame, k: int) -> None:
            batch.write.mode("overwrite").format(sink).save(f"{path}/batch={k}")
            if mode == "complete":
                at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={k - 2}")
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

        return write

    def written(self, path: str, schema: StructType, *, sink: str = "parquet", mode: str = "complete") -> DataFrame:
        """What a stream in complete mode (its last batch) or update mode (all its batches) has written to path."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = sorted(int(x.getPath().getName().removeprefix("batch=")) for x in fs.listStatus(at) if x.getPath().getName().startswith("batch=")) if fs.exists(at) else []
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).format(sink).load([f"{path}/batch={k}" for k in (found[-1:] if mode == "complete" else found)])

    def query(self, name: str) -> StreamingQuery:
        if name not in self._queries:
            raise EngineError(f"stream not found: {name}", NOT_FOUND)
        return self._queries[name]

    def stop(self, name: str) -> None:
        self.query(name).stop()

    def status(self) -> list[dict]:
        return [{"name": n, "active": q.isActive, "message": q.status["message"], "batch": (q.lastProgress or {}).get("batchId"), "error": str(q.exception()) if q.exception() else None} for n, q in self._queries.items()]
