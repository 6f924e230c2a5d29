"""Packets made from rows of the tables: every row becomes a frame by its numbers, so results can be told by SQL."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..net import filters
from ..net.identify import counts, identify
from ..net.sessions import sessions
from .catalog import query

#: Ports that made packets go to, in turn: DNS, HTTP's usual one without its words, SSH, NTP.
PORTS = (53, 80, 22, 123)


def packet(src: int, dst: int, sport: int, dport: int, payload: bytes, tcp: bool) -> bytes:
    """Ethernet, IPv4 and TCP or UDP around a payload."""
    inner = struct.pack("!HHIIBBHHH", sport, dport, 1, 0, 5 << 4, 0x18, 1024, 0, 0) if tcp else struct.pack("!HHHH", sport, dport, 8 + len(payload), 0)
    ip = struct.pack("!BBHHHBBHII", 0x45, 0, 20 + len(inner) + len(payload), 0, 0, 64, 6 if tcp else 17, 0, src, dst)
    return bytes(12) + b"\x08\x00" + ip + inner + payload


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """packet_no, ts, len, packet: one for each event, from 10.0.x.y by its user to 192.168.0.1."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [packet((10 << 24) + u % 65536, (192 << 24) + (168 << 16) + 1, 40000 + e % 1000, PORTS[e % 4], b"x" * (e % 5), e % 4 in (1, 2)) for e, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(list(map(len, made)), pa.int32()), pa.array(made, pa.binary())], names=["packet_no", "user_id", "ts", "len", "packet"])

    kind = dict(events.dtypes)["ts"]
    return events.mapInArrow(make, f"packet_no bigint, user_id bigint, ts {kind}, len int, packet binary")


@query("SELECT cast(CASE event_id % 4 WHEN 0 THEN 1024 WHEN 1 THEN 0 WHEN 2 THEN 1030 ELSE 1049 END AS int) AS proto_id, CASE event_id % 4 WHEN 0 THEN 'DNS' WHEN 2 THEN 'SSH' WHEN 3 THEN 'NTP' END AS protocol, count(*) AS packets FROM events GROUP BY 1, 2")
def packet_protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(identify(packets(spark, sf_dir)))


@query("SELECT event_id AS packet_no, cast(CASE WHEN event_id % 4 IN (1, 2) THEN 54 ELSE 42 END AS int) AS payload_offset, cast(event_id % 5 AS int) AS payload_length, '2@0,17@14,' || CASE WHEN event_id % 4 IN (1, 2) THEN '33@34' ELSE '34@34' END AS layers FROM events")
def packet_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array_join(F.transform("layers", lambda x: F.concat(x["layer"], F.lit("@"), x["offset"])), ",")
    return identify(packets(spark, sf_dir)).select("packet_no", "payload_offset", "payload_length", listed.alias("layers"))


@query("SELECT event_id AS packet_no FROM events WHERE user_id % 65536 BETWEEN 0 AND 255 AND event_id % 4 IN (0, 3)")
def capture_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(packets(spark, sf_dir))
    return found.where(filters.ip_address("10.0.0.0/24") & filters.port("53;123")).select("packet_no")


@query(
    "WITH p AS (SELECT ts, user_id % 65536 AS u, 40000 + event_id % 1000 AS sp, event_id % 4 AS k, (CASE WHEN event_id % 4 IN (1, 2) THEN 54 ELSE 42 END) + event_id % 5 AS len FROM events), "
    "f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY u, sp, k ORDER BY ts) < 30000000 THEN 0 ELSE 1 END AS fresh FROM p), "
    "s AS (SELECT *, sum(fresh) OVER (PARTITION BY u, sp, k ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM f) "
    "SELECT u, sp, cast(k AS int) AS k, count(*) AS packets, cast(sum(len) AS bigint) AS bytes FROM s GROUP BY u, sp, k, g"
)
def session_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions(identify(packets(spark, sf_dir)))
    # The client's end is the one with a high port.
    client = F.col("port_a") >= 40000
    ip, sp, dp = (F.when(client, a).otherwise(b) for a, b in ((F.col("ip_a"), F.col("ip_b")), (F.col("port_a"), F.col("port_b")), (F.col("port_b"), F.col("port_a"))))
    u = F.split(ip, r"\.")[2].cast("bigint") * 256 + F.split(ip, r"\.")[3].cast("bigint")
    k = F.when(dp == 53, 0).when(dp == 80, 1).when(dp == 22, 2).otherwise(3)
    return found.select(u.alias("u"), sp.cast("bigint").alias("sp"), k.alias("k"), "packets", "bytes")


def _eth(kind: int, data: bytes, mac: int = 0) -> bytes:
    return bytes(6) + mac.to_bytes(6, "big") + struct.pack("!H", kind) + data


def _ip4(proto: int, data: bytes, src: int, dst: int = (192 << 24) + (168 << 16) + 1) -> bytes:
    return struct.pack("!BBHHHBBHII", 0x45, 0, 20 + len(data), 0, 0, 64, proto, 0, src, dst) + data


def _ip6(data: bytes, src: int) -> bytes:
    """From 2001:db8::src to 2001:db8:1::1."""
    net = 0x20010DB8 << 96
    return struct.pack("!IHBB", 6 << 28, len(data), 17, 64) + (net + src).to_bytes(16, "big") + (net + (1 << 80) + 1).to_bytes(16, "big") + data


def _udp(port: int, data: bytes = b"") -> bytes:
    return struct.pack("!HHHH", 40000, port, 8 + len(data), 0) + data


def _tcp(port: int, data: bytes) -> bytes:
    return struct.pack("!HHIIBBHHH", 40000, port, 1, 0, 5 << 4, 0x18, 1024, 0, 0) + data


#: Ports and payloads by kind, in turn: a request of HTTP, records and messages as their standards have them.
PAYLOADS = (
    (True, 8081, b"GET /index HTTP/1.1\r\nHost: h\r\n\r\n"), (True, 8443, b"\x17\x03\x03\x00\x05hello"), (False, 40002, bytes([0x80, 96]) + bytes(10)),
    (True, 2121, b"RETR file\r\n"), (True, 102, b"\x03\x00\x00\x19\x02\xf0\x80\x32\x01" + bytes(16)), (True, 20000, b"\x05\x64" + bytes(8)),
    (False, 40003, bytes([0x81, 200, 0, 0])), (True, 1414, b"TSH " + bytes(4) + b"\x02" + bytes(8)), (False, 623, b"\x06\x00\xff\x07" + bytes(4)), (True, 102, b"\x03\x00\x00\x0f\x02\xf0\x80\x01\x00\x01\x00" + bytes(4)),
    (True, 8082, b"HTTP/1.1 200 OK\r\n\r\n"), (True, 9999, b"nothing that is known"),
)


def _inside(k: int, u: int) -> bytes:
    """A DNS packet in VLAN, GRE, MPLS or VXLAN, by turns."""
    src = (10 << 24) + u % 65536
    inner = _ip4(17, _udp(53, b"q"), src)
    if k == 0:
        return _eth(0x8100, b"\x00\x05\x08\x00" + inner)
    if k == 1:
        return _eth(0x0800, _ip4(47, b"\x00\x00\x08\x00" + inner, 1))
    if k == 2:
        return _eth(0x8847, b"\x00\x01\x01\x40" + inner)
    return _eth(0x0800, _ip4(17, _udp(4789, b"\x08" + bytes(7) + _eth(0x0800, inner)), 1))


def _payload_packet(e: int, u: int) -> bytes:
    tcp, port, data = PAYLOADS[e % len(PAYLOADS)]
    return _eth(0x0800, _ip4(6 if tcp else 17, _tcp(port, data) if tcp else _udp(port, data), (10 << 24) + u % 65536))


def made_packets(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """packet_no, user_id, ts, len, packet: make(event_id, user_id) for each event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [make(e, u) for e, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(list(map(len, made)), pa.int32()), pa.array(made, pa.binary())], names=["packet_no", "user_id", "ts", "len", "packet"])

    return events.mapInArrow(run, f"packet_no bigint, user_id bigint, ts {dict(events.dtypes)['ts']}, len int, packet binary")


def _engine(spark: SparkSession, **tables: DataFrame) -> Engine:
    engine = Engine(spark)
    for name, df in tables.items():
        engine.table(f"ss.{name}", df)
    return engine


@query(
    "SELECT CASE event_id % 12 WHEN 0 THEN 'HTTP' WHEN 1 THEN 'TLS' WHEN 2 THEN 'RTP' WHEN 3 THEN 'FTP' WHEN 4 THEN 'S7COMM' WHEN 5 THEN 'DNP3' WHEN 6 THEN 'RTCP' WHEN 7 THEN 'MQ' WHEN 8 THEN 'IPMI' WHEN 9 THEN 'MMS' WHEN 10 THEN 'HTTP' END AS protocol, count(*) AS packets FROM events GROUP BY 1"
)
def payload_protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protocols that only their payload tells."""
    found = _engine(spark, p=made_packets(spark, sf_dir, _payload_packet)).execute("SELECT packet FROM ss.p USING npi.identify").df
    return found.groupBy("protocol").agg(F.count(F.lit(1)).alias("packets"))


@query("SELECT event_id AS packet_no, CASE event_id % 4 WHEN 0 THEN '2,3,17,34' WHEN 1 THEN '2,17,25,17,34' WHEN 2 THEN '2,6,17,34' ELSE '2,17,34,37,2,17,34' END AS layers, '10.0.' || ((user_id % 65536) // 256) || '.' || (user_id % 256) AS src_ip, 1024 AS proto_id FROM events")
def tunnel_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers and innermost addresses inside VLAN, GRE, MPLS and VXLAN."""
    found = identify(made_packets(spark, sf_dir, lambda e, u: _inside(e % 4, u)))
    return found.select("packet_no", F.array_join(F.transform("layers", lambda x: x["layer"]), ",").alias("layers"), "src_ip", "proto_id")


@query("SELECT event_id AS packet_no FROM events WHERE user_id % 65536 < 256 AND event_id % 3 < 2")
def capture_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An IPv6 network on either end, for packets over IPv6."""
    frames = made_packets(spark, sf_dir, lambda e, u: _eth(0x86DD, _ip6(_udp(53), u % 65536)) if e % 3 < 2 else _eth(0x0800, _ip4(17, _udp(53), u % 65536)))
    return _engine(spark, p=frames).execute("SELECT * FROM ss.p USING npi.identify THEN capture.ipaddress WITH value='2001:db8::/120'").df.select("packet_no")


@query("SELECT event_id AS packet_no FROM events WHERE user_id = 12")
def capture_mac(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = made_packets(spark, sf_dir, lambda e, u: _eth(0x0800, _ip4(17, _udp(53), 1), u))
    return _engine(spark, p=frames).execute("SELECT * FROM ss.p USING npi.identify THEN capture.macaddress WITH value='00-00-00-00-00-0C'").df.select("packet_no")


@query("SELECT event_id AS packet_no FROM events WHERE user_id % 65536 BETWEEN 1 AND 20 AND event_id % 4 = 0")
def capture_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of addresses on one end and an address on the other, of one protocol."""
    engine = _engine(spark, p=packets(spark, sf_dir))
    return engine.execute("SELECT * FROM ss.p USING npi.identify THEN capture.ipaddress WITH value='10.0.0.1-10.0.0.20,192.168.0.1' THEN capture.protocol WITH value='dns'").df.select("packet_no")


@query("SELECT event_id + 1 AS packet_no, CASE WHEN event_id % 4 IN (1, 2) THEN 54 ELSE 42 END + event_id % 5 AS caplen, ts FROM events")
def capture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures written as files, one or more a task, and read as a channel; packets are numbered in their file, and so on over files in order."""
    from ..session import shared_folder
    from ..sources import pcap

    rows = packets(spark, sf_dir).select("packet_no", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "packet").orderBy("packet_no").select("at", "packet")
    folder = f"{shared_folder(spark)}/capture-{uuid.uuid4().hex}"
    starts, before = [], 0
    for name, n in pcap.write(rows, folder):
        starts.append((name, before))
        before += n
    engine = Engine(spark)
    engine.files("ss.capture", folder, "pcap")
    found = engine.execute("SELECT substring_index(file, '/', -1) AS name, packet_no, cast(caplen AS bigint) AS caplen, cast(ts AS timestamp_ntz) AS ts FROM ss.capture").df
    # A row for each file.
    return found.join(F.broadcast(spark.createDataFrame(starts, "name string, before bigint")), "name").select((F.col("before") + F.col("packet_no")).alias("packet_no"), "caplen", "ts")


@query("SELECT event_id AS packet_no, cast(least(20, CASE WHEN event_id % 4 IN (1, 2) THEN 54 ELSE 42 END + event_id % 5) AS int) AS cut, cast(CASE WHEN event_id % 4 IN (1, 2) THEN 54 ELSE 42 END + least(2, event_id % 5) AS int) AS headers FROM events")
def storage_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole packets cut to 20 bytes, and payloads to two."""
    engine = _engine(spark, p=packets(spark, sf_dir))
    cut = engine.execute("SELECT * FROM ss.p USING cut.packet WITH size=20").df.select("packet_no", F.octet_length("packet").alias("cut"))
    return cut.join(engine.execute("SELECT * FROM ss.p USING npi.identify THEN cut.payload WITH size=2").df.select("packet_no", F.octet_length("packet").alias("headers")), "packet_no")


@query("SELECT policy, event_id AS packet_no FROM events, (SELECT unnest(['encrypted', 'dns', 'only', 'place']) AS policy) WHERE (policy = 'encrypted' AND event_id % 4 <> 2) OR (policy = 'dns' AND event_id % 4 <> 0) OR (policy = 'only' AND event_id % 4 IN (2, 3)) OR (policy = 'place' AND (event_id % 4 = 3 OR user_id % 65536 = 9))")
def storage_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each policy keeps."""
    engine = _engine(spark, p=packets(spark, sf_dir))
    engine.frames.bind("seen", engine.execute("SELECT * FROM ss.p USING npi.identify").df)
    policies = {"encrypted": "exclude.encrypted", "dns": "exclude.protocol WITH value='dns'", "only": "include.protocol WITH value='ssh,ntp'", "place": "include.address WITH ipaddress='10.0.0.9', port='123'"}
    parts = [engine.execute(f"SELECT * FROM dataframe.seen USING {sql}").df.select(F.lit(name).alias("policy"), "packet_no") for name, sql in policies.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("SELECT CASE WHEN event_id % 4 = 0 THEN 'resolver' WHEN event_id % 4 = 1 THEN 'web' WHEN user_id % 65536 < 256 THEN 'office' ELSE 'rest' END AS application, count(*) AS n FROM events GROUP BY 1")
def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by protocol, port and network; the first that holds counts."""
    engine = _engine(spark, p=packets(spark, sf_dir))
    engine.frames.bind("seen", engine.execute("SELECT * FROM ss.p USING npi.identify").df)
    rules = [("resolver", "DNS", None, None), ("web", None, None, "80-81"), ("office", None, "10.0.0.0/24", None), ("rest", None, None, None)]
    engine.frames.bind("rules", spark.createDataFrame(rules, "application string, protocol string, ip string, port string").coalesce(1))
    return engine.execute("SELECT * FROM dataframe.seen, dataframe.rules USING npi.application").df.groupBy("application").agg(F.count(F.lit(1)).alias("n"))


DICTIONARY = """
- {name: EVEN, id: 70001, description: even first byte, parent: 70000, rules: [{level: udp, enumerate: '0:0:1'}]}
- {name: ANY, id: 70002, description: two bytes of anything, rules: [{level: udp, enumerate: '*:1:1'}]}
- {name: WORD, id: 70003, description: a word, rules: [{level: tcp, pattern: 'ab+c'}]}
- {name: WORD, id: 70004, description: again}
- {name: NONE, id: 70005}
"""


@query("SELECT cast(CASE event_id % 4 WHEN 0 THEN 70001 WHEN 1 THEN 70002 WHEN 2 THEN 70003 ELSE 0 END AS int) AS proto_id, cast(CASE event_id % 4 WHEN 0 THEN 70000 WHEN 1 THEN 70002 WHEN 2 THEN 70003 ELSE 0 END AS int) AS proto_parent, count(*) AS n FROM events GROUP BY 1, 2")
def dictionary_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a dictionary file: bytes at an offset, patterns, parents; entries that repeat or say nothing are left out."""
    from ..net.rules import Model, from_yaml

    def make(e: int, u: int) -> bytes:
        udp = _udp(7, b"\x00" if e % 4 == 0 else b"\x07\x07") if e % 4 < 2 else None
        return _eth(0x0800, _ip4(17, udp, 1) if udp else _ip4(6, _tcp(7, b"abbbc" if e % 4 == 2 else b"xyz"), 1))

    found = identify(made_packets(spark, sf_dir, make), Model(from_yaml(DICTIONARY)))
    return found.groupBy("proto_id", "proto_parent").agg(F.count(F.lit(1)).alias("n"))
