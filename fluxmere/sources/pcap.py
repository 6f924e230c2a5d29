"""Packet captures as a Python data source: (packet_no, ts, caplen, len, packet) of classic pcap files in either byte order."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file string, packet_no bigint, ts timestamp, caplen int, len int, packet binary"
#: Magic numbers of the format and the fraction of a second that its clock counts; fixed values.
MAGIC = {0xA1B2C3D4: 1_000_000, 0xA1B23C4D: 1_000_000_000}
GLOBAL, RECORD = 24, 16
BATCH_BYTES = 4 << 20
#: What a file that we write starts with, and the bytes after which a task goes on in another one: a file is read by one task.
HEAD = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
FILE_BYTES = 64 << 20
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return pafs.FileSystem.from_uri(path)


@dataclass
class Capture(InputPartition):
    path: str


class PcapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PcapReader:
        return PcapReader(self.options["path"])


class PcapReader(DataSourceReader):
    """A partition a file: records can't be found from the middle of one."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Capture]:
        fs, root = _fs(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.is_file else [x for x in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if x.is_file and not x.base_name.startswith(".")]
        return [Capture(x.path) for x in files] or [Capture("")]

    def read(self, partition: Capture) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = _fs(self.path)
        schema = pa.schema([("file", pa.string()), ("packet_no", pa.int64()), ("ts", pa.timestamp("us", "UTC")), ("caplen", pa.int32()), ("len", pa.int32()), ("packet", pa.binary())])
        with fs.open_input_stream(partition.path, compression=None, buffer_size=1 << 20) as file:
            rows, size = [], 0
            for row in packets(file, partition.path):
                rows.append(row)
                size += RECORD + row["caplen"]
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def packets(file, name: str) -> Iterator[dict]:
    """Records in order; a record cut off at the file's end is left out."""
    head = file.read(GLOBAL)
    if len(head) < GLOBAL:
        return
    order = next((o for o in "<>" if struct.unpack(f"{o}I", head[:4])[0] in MAGIC), None)
    if order is None:
        raise ValueError(f"{name}: not a pcap file")
    clock = MAGIC[struct.unpack(f"{order}I", head[:4])[0]]
    number = 0
    while len(head := file.read(RECORD)) == RECORD:
        seconds, fraction, caplen, length = struct.unpack(f"{order}IIII", head)
        data = file.read(caplen)
        if len(data) < caplen:
            return
        number += 1
        yield {"file": name, "packet_no": number, "ts": EPOCH + timedelta(seconds=seconds, microseconds=fraction * 1_000_000 // clock), "caplen": caplen, "len": length, "packet": data}


def dump(frames: list[tuple[float, bytes]]) -> bytes:
    """A capture file of (seconds, packet)."""
    out = [HEAD]
    for at, data in frames:
        out.append(struct.pack("<IIII", int(at), round(at % 1 * 1_000_000), len(data), len(data)) + data)
    return b"".join(out)


def write(rows: DataFrame, folder: str, *, file_bytes: int = FILE_BYTES) -> list[tuple[str, int]]:
    """Writes rows of (microseconds, packet) as capture files of about file_bytes at most; returns (name, packets) of each.

    In order of their names the files hold the rows in order of partitions. A task keeps one batch of rows, not a file.
    """
    fs, root = _fs(folder.rstrip("/"))
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder.rstrip("/"))
        context = TaskContext.get()
        rows, done = ((a, d) for b in batches for a, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), []
        row = next(rows, None)
        while row is not None:
            name, size, n = f"part-{context.partitionId():06d}-{len(done):06d}.pcap", len(HEAD), 0
            # Under a name of its own attempt until it is whole.
            with fs.open_output_stream(f"{root}/.{name}.{context.taskAttemptId()}", compression=None, buffer_size=1 << 20) as file:
                file.write(HEAD)
                while row is not None and (not n or size < file_bytes):
                    at, data = row
                    file.write(struct.pack("<IIII", *divmod(at, 1_000_000), len(data), len(data)) + data)
                    size, n = size + RECORD + len(data), n + 1
                    row = next(rows, None)
            fs.move(f"{root}/.{name}.{context.taskAttemptId()}", f"{root}/{name}")
            done.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["name", "n"])

    # Two values for each file of FILE_BYTES.
    return sorted(map(tuple, rows.mapInArrow(run, "name string, n bigint").collect()))


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PcapSource)
    return spark.read.format("pcap").load(path)
