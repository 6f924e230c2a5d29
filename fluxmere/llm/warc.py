"""WARC 1.1 archives as a Python data source: `spark.read.format("warc")` and `df.write.format("warc")`.

Reading plans partitions from byte ranges of files; a partition starts at the first record that begins in
its range. Headers are parsed first. Predicates on record type and headers, from options or pushed down by
Spark, are tried on them; what fails is skipped without decoding: by the length that this writer notes in
each gzip member's extra field, or by Content-Length in a plain file. Payloads are decoded only if asked for.

Files are reached by path, file:// or any address that pyarrow's file systems know (hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import bounded_batches, shared_dir, written

SCHEMA = "record_type string, record_id string, target_uri string, date string, payload_digest string, payload_bytes bigint, refers_to string, row_id string, refers_to_row_id string, headers map<string,string>, payload binary"
#: What a writer's input must have; a null payload is an empty one.
INPUT = "row_id string, record_type string, target_uri string, payload binary, refers_to_row_id string, refers_to_uri string"
#: Profile of a revisit, fixed by the WARC standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Headers of this writer: the row's id, that of the row it refers to, and the length of the whole payload.
ROW, REFERS, LENGTH = "X-Row-Id", "X-Refers-To-Row-Id", "X-Payload-Length"
#: Subfield of a gzip member's extra field: compressed length of the member's data, then raw length.
EXTRA = b"SL"
#: Bytes read at once, bytes of payload in an output batch, bytes at which a file is full.
CHUNK, BATCH, FULL = 1 << 16, 8 << 20, 256 << 20
#: Files that a commit moves at once.
MOVERS = 16
#: Characters of an id that stand for themselves in a header: all printable ones of ASCII but the sign that quotes others.
SAFE = "".join(map(chr, range(33, 127))).replace("%", "") + " "
COLUMN_HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "row_id": ROW.lower(), "refers_to_row_id": REFERS.lower()}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(row_id: str | None, digest: str, uri: str | None) -> str:
    """The same record gets the same id in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row_id} {digest} {uri}')}>"


def _line(value: str) -> str:
    """A header's value can't hold a line end."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if re.search(r"[\r\n]", value) else value


def _id(value: str) -> str:
    """Any id as a header's value; unquoted when read."""
    return quote(value, safe=SAFE)


def record(row_id: str | None, kind: str, uri: str | None, payload: bytes, refers: str | None, date: str, refers_uri: str | None = None) -> bytes:
    """A record as bytes. A revisit names the record that it repeats by id, address and date, as the standard has it."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_urn(row_id, digest, uri)), ("WARC-Date", date)]
    if uri is not None:
        head.append(("WARC-Target-URI", _line(uri)))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), (LENGTH, str(len(payload)))]
    if row_id is not None:
        head.append((ROW, _id(row_id)))
    if kind == "revisit":
        head.append(("WARC-Profile", PROFILE))
        if refers is not None:
            head += [("WARC-Refers-To", record_urn(refers, digest, refers_uri)), ("WARC-Refers-To-Date", date), (REFERS, _id(refers))]
            if refers_uri is not None:
                head.append(("WARC-Refers-To-Target-URI", _line(refers_uri)))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member that tells its own length in the extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    extra = EXTRA + struct.pack("<HQQ", 16, len(body) + 8, len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcSource(DataSource):
    """Options: compress (gzip or none), level, date for writing; types (comma-separated), header.<Name> (equals), payload (false: null payloads), verify and split (bytes) for reading."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files below _temporary; the commit moves those of the tasks that count."""

    def __init__(self, options, overwrite: bool) -> None:
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex
        self.gz, self.level, self.date = options.get("compress", "gzip") == "gzip", int(options.get("level", "3")), options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.path)
        fs.create_dir(f"{root}/_temporary/{self.run}", recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            columns = (batch.column(batch.schema.get_field_index(c)) for c in ("row_id", "record_type", "target_uri", "payload", "refers_to_row_id", "refers_to_uri"))
            for row_id, kind, uri, payload, refers, refers_uri in zip(*columns, strict=True):
                if out is None:
                    files.append(f"{uuid.uuid4().hex}.warc{'.gz' if self.gz else ''}")
                    out, size = fs.open_output_stream(f"{root}/_temporary/{self.run}/{files[-1]}", compression=None), 0
                data = record(row_id.as_py(), kind.as_py(), uri.as_py(), payload.as_py() or b"", refers.as_py(), self.date, refers_uri.as_py())
                data = member(data, self.level) if self.gz else data
                out.write(data)
                size += len(data)
                if size >= FULL:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for x in fs.get_file_info(pafs.FileSelector(root)):
                if x.is_file and re.search(r"\.warc(\.gz)?$", x.path):
                    fs.delete_file(x.path)
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda f: fs.move(f"{root}/_temporary/{self.run}/{f}", f"{root}/{f}"), [f for m in messages if m for f in m.files]))
        self._clear(fs, root)

    def abort(self, messages: list) -> None:
        self._clear(*file_system(self.path))

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/_temporary/{self.run}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/_temporary/{self.run}")


class WarcReader(DataSourceReader):
    def __init__(self, options, schema: StructType) -> None:
        self.path, self.schema = options["path"], schema
        self.split, self.payload, self.verify = int(options.get("split", 32 << 20)), options.get("payload", "true") != "false", options.get("verify", "false") == "true"
        #: Header (lower case) to the set of values that pass; None: any; a prefix as a string.
        self.wanted: list[tuple[str, frozenset | str | None]] = [(k[len("header.") :].lower(), frozenset([v])) for k, v in options.items() if k.lower().startswith("header.")]
        if "types" in options:
            self.wanted.append(("warc-type", frozenset(x.strip() for x in options["types"].split(","))))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes equality, IN, prefix and IS NOT NULL on the columns that are headers; Spark filters the rest."""
        for f in filters:
            name = COLUMN_HEADERS.get(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            said = {"warc-payload-digest": "sha1:{}".format, ROW.lower(): _id, REFERS.lower(): _id}.get(name, str)
            if name and isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self.wanted.append((name, frozenset([said(f.value)])))
            elif name and isinstance(f, In):
                self.wanted.append((name, frozenset(said(v) for v in f.value if v is not None)))
            elif name and isinstance(f, StringStartsWith):
                self.wanted.append((name, said(f.value)))
            elif name and isinstance(f, IsNotNull):
                self.wanted.append((name, None))
            else:
                yield f

    def partitions(self) -> list[Range]:
        fs, root = file_system(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root))
        found = [Range(x.path, a, min(x.size, a + self.split)) for x in files if x.is_file and re.search(r"\.warc(\.gz)?$", x.path) for a in range(0, x.size, self.split)]
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = file_system(self.path)
        rows: list[dict] = []
        size = 0
        arrow = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("row_id", pa.string()), ("refers_to_row_id", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        with fs.open_input_file(partition.path) as file:
            source = _Gzip(file) if partition.path.endswith(".gz") else _Plain(file)
            for head, payload_of in source.records(partition.start, partition.end):
                if not self._passes(head):
                    continue
                row = self._row(head, payload_of)
                rows.append(row)
                size += len(row["payload"] or b"") + 512
                if size >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def _passes(self, head: dict) -> bool:
        for name, values in self.wanted:
            own = head.get(name)
            if own is None or not (values is None or (own.startswith(values) if isinstance(values, str) else own in values)):
                return False
        return True

    def _row(self, head: dict, payload_of) -> dict:
        whole = head.get("warc-type") in ("response", "resource", "conversion")
        payload = payload_of() if self.payload and whole else None
        digest = (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        if payload is not None:
            real = base32_sha1(payload)
            if self.verify and digest and real != digest:
                raise ValueError(f"the payload of {head.get('warc-record-id')} has digest {real}, its header says {digest}")
            digest, length = real, len(payload)
        else:
            length = int(head[LENGTH.lower()]) if LENGTH.lower() in head else None
        given = lambda k: unquote(head[k]) if k in head else None
        return {
            "record_type": head.get("warc-type"), "record_id": head.get("warc-record-id"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "payload_digest": digest, "payload_bytes": length,
            "refers_to": head.get("warc-refers-to"), "row_id": given(ROW.lower()), "refers_to_row_id": given(REFERS.lower()), "headers": list(head.items()), "payload": payload,
        }


def _headers(raw: bytes) -> dict:
    """Names in lower case; a line that starts with a blank goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _payload(head: dict, block: bytes) -> bytes:
    """The block without the HTTP head where it has one."""
    if head.get("content-type", "").startswith("application/http"):
        at = block.find(b"\r\n\r\n")
        return block[at + 4 :] if at >= 0 else b""
    return block


class _Plain:
    def __init__(self, file) -> None:
        self.file = file

    def records(self, start: int, end: int) -> Iterator[tuple[dict, object]]:
        at = self._sync(start, end)
        while at is not None and at < end:
            raw, body = self._head(at)
            if raw is None:
                return
            head = _headers(raw)
            length = int(head.get("content-length", "0"))

            def payload(body=body, length=length, head=head) -> bytes:
                return _payload(head, self.file.read_at(length, body))

            yield head, payload
            at = body + length + 4

    def _head(self, at: int) -> tuple[bytes | None, int]:
        raw = b""
        while (cut := raw.find(b"\r\n\r\n")) < 0:
            more = self.file.read_at(CHUNK, at + len(raw))
            if not more:
                return None, 0
            raw += more
        return (raw[:cut], at + cut + 4) if raw.startswith(b"WARC/") else (None, 0)

    def _sync(self, start: int, end: int) -> int | None:
        """The first record that begins in the range; a body with a line like a record's start is told apart by its headers."""
        if start == 0:
            return 0
        at = start - 4
        while at < end:
            raw = self.file.read_at(CHUNK + 16, at)
            found = raw.find(b"\r\n\r\nWARC/1.")
            if found >= 0 and at + found + 4 < end:
                head, _ = self._head(at + found + 4)
                if head and {"warc-type", "content-length"} <= _headers(head).keys():
                    return at + found + 4
                at += found + 4
            elif found >= 0 or len(raw) < CHUNK + 16:
                return None
            else:
                at += CHUNK
        return None


class _Gzip:
    def __init__(self, file) -> None:
        self.file, self.size = file, file.size()

    def records(self, start: int, end: int) -> Iterator[tuple[dict, object]]:
        at = self._sync(start, end)
        while at is not None and at < end:
            inflate, raw, place = zlib.decompressobj(31), b"", at
            while (cut := raw.find(b"\r\n\r\n")) < 0 and not inflate.eof:
                more = inflate.unconsumed_tail or self.file.read_at(CHUNK, place)
                if not more:
                    return
                place += 0 if inflate.unconsumed_tail else len(more)
                raw += inflate.decompress(more, CHUNK)
            if cut < 0 or not raw.startswith(b"WARC/"):
                return
            head, after = _headers(raw[:cut]), self._skip(at)
            state = {"inflate": inflate, "place": place, "data": [raw[cut + 4 :]], "end": after}
            length = int(head.get("content-length", "0"))

            def payload(state=state, head=head, length=length) -> bytes:
                self._rest(state, keep=True)
                return _payload(head, b"".join(state["data"])[:length])

            yield head, payload
            if state["end"] is None:
                self._rest(state, keep=False)
            at = state["end"]

    def _rest(self, state: dict, keep: bool) -> None:
        """Inflate to the end of the member."""
        inflate = state["inflate"]
        while not inflate.eof:
            more = inflate.unconsumed_tail or self.file.read_at(CHUNK, state["place"])
            if not more:
                break
            state["place"] += 0 if inflate.unconsumed_tail else len(more)
            data = inflate.decompress(more, 1 << 20)
            if keep:
                state["data"].append(data)
        state["end"] = state["end"] or state["place"] - len(inflate.unused_data)

    def _skip(self, at: int) -> int | None:
        """Where the member at a place ends, if its extra field tells."""
        head = self.file.read_at(12, at)
        if len(head) < 12 or not head[3] & 4 or head[3] & ~4:
            return None
        (n,) = struct.unpack("<H", head[10:12])
        extra, k = self.file.read_at(n, at + 12), 0
        while k + 4 <= len(extra):
            (size,) = struct.unpack("<H", extra[k + 2 : k + 4])
            if extra[k : k + 2] == EXTRA and size == 16:
                return at + 12 + n + struct.unpack("<Q", extra[k + 4 : k + 12])[0]
            k += 4 + size
        return None

    def _sync(self, start: int, end: int) -> int | None:
        """The first member that begins in the range and holds a record."""
        if start == 0:
            return 0
        at = start
        while at < end:
            raw = self.file.read_at(CHUNK + 3, at)
            found = raw.find(b"\x1f\x8b\x08")
            if found < 0 or at + found >= end:
                if found >= 0 or len(raw) < CHUNK + 3:
                    return None
                at += CHUNK
                continue
            try:
                if zlib.decompressobj(31).decompress(self.file.read_at(CHUNK, at + found), 5) == b"WARC/":
                    return at + found
            except zlib.error:
                pass
            at += found + 1
        return None


def archived(pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Pages as input rows of the writer: of rows with equal payloads those with the smallest id are responses, the others revisit it.

    Ids are of any type with an order that a string holds. Defined results: a null html is an empty payload; a null id sorts last, and where all ids are
    null all rows are responses; rows that repeat the smallest id are responses all. Only the
    digests of payloads that occur more than once are joined back.
    """
    read = pages.select(F.col(id_column).alias("row_id"), F.col(url_column).alias("target_uri"), F.coalesce(html_column, F.lit("")).cast("binary").alias("payload"))
    keys = [F.sha1("payload").alias("digest"), F.xxhash64("payload").alias("check")]
    place = F.struct(F.col("row_id").isNull().alias("none"), F.col("row_id").alias("id"), F.col("target_uri").alias("uri"))
    shared = read.select("row_id", "target_uri", *keys).groupBy("digest", "check").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1 and not first.none").drop("n")
    joined = read.select("*", *keys).join(written(shared), ["digest", "check"], "left")
    revisit = F.col("first").isNotNull() & (F.col("row_id").isNull() | (F.col("row_id") > F.col("first.id")))
    own = F.when(revisit, F.col("first"))
    return joined.select(F.col("row_id").cast("string").alias("row_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", "payload", own["id"].cast("string").alias("refers_to_row_id"), own["uri"].alias("refers_to_uri"))


def write_archives(records: DataFrame, path: str, **options) -> None:
    records.sparkSession.dataSource.register(WarcSource)
    bounded_batches(records).write.format("warc").mode("append").options(**options).save(path)


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    """Records of a file or folder; filters on the columns that are headers are pushed into the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").options(**options).load(path)


def round_trip(pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Write pages to new archives in the shared folder and read every record back: id, payload_bytes, payload_digest, record_type, refers_to, target_uri."""
    path = f"{shared_dir(pages.sparkSession)}/warc"
    write_archives(archived(pages, id_column=id_column, url_column=url_column, html_column=html_column), path)
    found = read_archives(pages.sparkSession, path, verify="true")
    kind = pages.schema[id_column].dataType
    return found.select(F.col("row_id").cast(kind).alias(id_column), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_row_id").cast(kind).alias("refers_to"), F.col("refers_to").alias("refers_to_record"), "target_uri")
