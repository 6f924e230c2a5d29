"""Packets by hand."""

import struct

import pytest

from fluxmere.net import layers as L
from fluxmere.net.filters import ip_address, mac_address, port
from fluxmere.net.identify import identify, named, protocol_of
from fluxmere.net.layers import decode
from fluxmere.net.rules import Model, from_yaml
from fluxmere.net.sessions import sessions
from fluxmere.net.storage import OPERATORS as STORAGE
from fluxmere.sources import pcap

MODEL = Model()


def eth(kind, data, src=b"\x00\x15\x5d\xb1\x37\x24"):
    return b"\x02" * 6 + src + struct.pack("!H", kind) + data


def ip4(proto, data, src=(10, 0, 0, 1), dst=(8, 8, 8, 8), fragment=0):
    return struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(data), 0, fragment, 64, proto, 0) + bytes(src) + bytes(dst) + data


def ip6(proto, data):
    return struct.pack("!IHBB", 6 << 28, len(data), proto, 64) + bytes(15) + b"\x01" + bytes(15) + b"\x02" + data


def tcp(sport, dport, data=b"", flags=0x18):
    return struct.pack("!HHIIBBHHH", sport, dport, 1, 0, 5 << 4, flags, 1024, 0, 0) + data


def udp(sport, dport, data=b""):
    return struct.pack("!HHHH", sport, dport, 8 + len(data), 0) + data


INNER = eth(0x0800, ip4(17, udp(5000, 53, b"q")))
CASES = {
    "http": (eth(0x0800, ip4(6, tcp(4000, 8080, b"GET / HTTP/1.1\r\nHost: x\r\n\r\n"))), [L.ETHERNET, L.IPV4, L.TCP], "HTTP"),
    "dns": (INNER, [L.ETHERNET, L.IPV4, L.UDP], "DNS"),
    "reply": (eth(0x0800, ip4(17, udp(53, 5000, b"r"))), [L.ETHERNET, L.IPV4, L.UDP], "DNS"),
    "icmp": (eth(0x0800, ip4(1, b"\x08\x00\x00\x00")), [L.ETHERNET, L.IPV4], "ICMP"),
    "arp": (eth(0x0806, bytes(28)), [L.ETHERNET], "ARP"),
    "vlan6": (eth(0x8100, b"\x00\x05\x86\xdd" + ip6(17, udp(123, 123))), [L.ETHERNET, L.VLAN, L.IPV6, L.UDP], "NTP"),
    "hop": (eth(0x86DD, ip6(0, b"\x06\x00" + bytes(6) + tcp(1, 22))), [L.ETHERNET, L.IPV6, L.HOPOPTS, L.TCP], "SSH"),
    "vxlan": (eth(0x0800, ip4(17, udp(9, 4789, bytes(8) + INNER))), [L.ETHERNET, L.IPV4, L.UDP, L.VXLAN, L.ETHERNET, L.IPV4, L.UDP], "DNS"),
    "gpe": (eth(0x0800, ip4(17, udp(9, 4790, bytes(3) + b"\x01" + bytes(4) + ip4(6, tcp(1, 25))))), [L.ETHERNET, L.IPV4, L.UDP, L.VXLAN_GPE, L.IPV4, L.TCP], "SMTP"),
    "gre": (eth(0x0800, ip4(47, b"\x20\x00\x08\x00" + bytes(4) + ip4(6, tcp(1, 443, b"\x16\x03\x01\x00\x05\x01\x00\x00\x01\x03\x03")))), [L.ETHERNET, L.IPV4, L.GRE, L.IPV4, L.TCP], "TLS"),
    "geneve": (eth(0x0800, ip4(17, udp(9, 6081, b"\x01\x00\x65\x58" + bytes(4) + bytes(4) + INNER))), [L.ETHERNET, L.IPV4, L.UDP, L.GENEVE, L.ETHERNET, L.IPV4, L.UDP], "DNS"),
    "mpls": (eth(0x8847, b"\x00\x01\x00\x40" + b"\x00\x02\x01\x40" + ip4(6, tcp(1, 179))), [L.ETHERNET, L.MPLS, L.MPLS, L.IPV4, L.TCP], "BGP"),
    "pppoe": (eth(0x8864, b"\x11\x00\x00\x01\x00\x10" + b"\x00\x21" + ip4(17, udp(1, 69))), [L.ETHERNET, L.PPPOE, L.PPP, L.IPV4, L.UDP], "TFTP"),
    "l2tp": (eth(0x0800, ip4(17, udp(1701, 1701, b"\x40\x02\x00\x30\x00\x01\x00\x02" + b"\xff\x03\x00\x21" + ip4(6, tcp(1, 110))))), [L.ETHERNET, L.IPV4, L.UDP, L.L2TP, L.PPP, L.IPV4, L.TCP], "POP3"),
    "gtp": (eth(0x0800, ip4(17, udp(9, 2152, b"\x30\xff\x00\x30\x00\x00\x00\x01" + ip4(17, udp(1, 161))))), [L.ETHERNET, L.IPV4, L.UDP, L.GTP, L.IPV4, L.UDP], "SNMP"),
    "sctp": (eth(0x0800, ip4(132, struct.pack("!HHII", 1, 2, 0, 0) + b"\x00\x03\x00\x14" + bytes(12) + b"data")), [L.ETHERNET, L.IPV4, L.SCTP], None),
    "esp": (eth(0x86DD, ip6(50, bytes(16))), [L.ETHERNET, L.IPV6, L.ESP], None),
    "fragment": (eth(0x0800, ip4(17, bytes(8), fragment=100)), [L.ETHERNET, L.IPV4], None),
    "dnp3": (eth(0x0800, ip4(6, tcp(1, 20000, b"\x05\x64" + bytes(8)))), [L.ETHERNET, L.IPV4, L.TCP], "DNP3"),
    "not dnp3": (eth(0x0800, ip4(6, tcp(1, 20000, b"zz"))), [L.ETHERNET, L.IPV4, L.TCP], None),
    "cut": (INNER[:25], [L.ETHERNET], None),
    "empty": (b"", [], None),
}


@pytest.mark.parametrize("name", CASES)
def test_layers_and_protocol(name):
    data, expected, protocol = CASES[name]
    p = decode(data)
    assert [k for _, k in p.layers] == expected
    names = {x.id: x.name for x in MODEL.protocols}
    assert names.get(protocol_of(p, data, MODEL)) == protocol


def test_offsets_and_padding():
    p = decode(INNER + bytes(18))
    assert (p.layers, p.payload, p.end - p.payload) == ([(0, L.ETHERNET), (14, L.IPV4), (34, L.UDP)], 42, 1)


def test_at_most_fifteen_layers():
    assert len(decode(eth(0x8100, b"\x00\x01\x81\x00" * 40)).layers) == L.MOST


def test_dictionary_file():
    found = from_yaml("- {name: A, id: 1, description: a, rules: [{level: udp, values: [9], enumerate: '258:1:2'}]}\n- {name: A, id: 2, description: again}\n- {name: B, id: 3}\n- {name: C, id: 4, description: c, parent: 1, rules: [{level: udp, values: 7}]}\n")
    assert [(p.name, p.parent) for p in found] == [("A", 1), ("C", 1)]
    model = Model(found)
    for payload, port_, want in ((b"\x00\x01\x02", 9, 1), (b"\x00\x01\x03", 9, 0), (b"\x00", 9, 0), (b"", 7, 4)):
        data = eth(0x0800, ip4(17, udp(1, port_, payload)))
        assert protocol_of(decode(data), data, model) == want


def test_capture_to_sessions(spark, tmp_path):
    frames = [(1000.0, eth(0x0800, ip4(6, tcp(4000, 80, b"", 2)))), (1001.5, eth(0x0800, ip4(6, tcp(80, 4000, b"x", 0x12), src=(8, 8, 8, 8), dst=(10, 0, 0, 1)))), (1100.0, eth(0x0800, ip4(6, tcp(4000, 80, b"", 1)))), (1000.0, INNER)]
    path = tmp_path / "a.pcap"
    path.write_bytes(pcap.dump(frames) + b"\x01\x02")  # a record that is cut off
    df = pcap.read(spark, str(path))
    assert [r.packet_no for r in df.orderBy("packet_no").collect()] == [1, 2, 3, 4]
    found = identify(df)
    assert {r.protocol for r in named(found).collect()} == {None, "DNS"}
    got = sorted((r.packets, r.opened, r.closed, r.duration) for r in sessions(found).where("ip_protocol = 6").collect())
    assert got == [(1, False, True, 0.0), (2, True, False, 1.5)]
    assert found.where(ip_address("10.0.0.0/8,8.8.8.8") & port("80-90")).count() == 3
    assert found.where(mac_address("00-15-5D-B1-37-24")).count() == 4
    assert found.where(ip_address("10.0.0.2-10.0.0.9")).count() == 0
    cut = {o.full: o for o in STORAGE}
    assert cut["cut.packet"]([found], {"size": "20"}).first().packet == frames[0][1][:20]
    assert cut["exclude.encrypted"]([named(found)], {}).count() == 4
    assert cut["include.protocol"]([named(found)], {"value": "['dns']"}).count() == 1


def test_applications_in_sql(spark, tmp_path):
    from fluxmere.engine import Engine

    path = tmp_path / "b.pcap"
    path.write_bytes(pcap.dump([(1.0, INNER), (2.0, CASES["http"][0]), (3.0, CASES["arp"][0])]))
    engine = Engine(spark)
    engine.files("ss.packets", str(path), "pcap")
    engine.execute("SELECT * FROM ss.packets USING npi.identify INTO dataframe.seen")
    rules = [("resolver", "DNS", "8.8.0.0/16", None), ("web", None, None, "8000-8100;443"), ("any", None, None, None)]
    engine.frames.register("rules", spark.createDataFrame(rules, "application string, protocol string, ip string, port string").coalesce(1))
    found = engine.execute("SELECT * FROM dataframe.seen, dataframe.rules USING npi.application").df
    assert {r.packet_no: r.application for r in found.collect()} == {1: "resolver", 2: "web", 3: "any"}
    stats = engine.execute("SELECT * FROM ss.packets USING npm.basic WITH idle=5").df
    assert stats.count() == 2
    assert engine.execute("SELECT * FROM dataframe.seen USING capture.ipaddress WITH value='10.0.0.1' THEN npi.protocols").df.count() == 2


def test_captures_in_many_files(spark, tmp_path):
    """Rows in order over files of a bounded size, several a task; what an attempt left unfinished isn't read; empty packets count."""
    rows = spark.range(3000, numPartitions=3).selectExpr("1700000000999999 + id AS at", "cast(repeat('x', cast(id % 7 AS int)) AS binary) AS packet")
    made = pcap.write(rows, f"file://{tmp_path}/out", file_bytes=4000)
    (tmp_path / "out" / ".part-000000-000000.pcap.7").write_bytes(b"unfinished")
    assert len(made) > 10 and sum(n for _, n in made) == 3000
    assert max(f.stat().st_size for f in (tmp_path / "out").glob("part-*")) < 4100
    found = pcap.read(spark, str(tmp_path / "out")).selectExpr("substring_index(file, '/', -1) AS name", "packet_no", "unix_micros(ts) AS at", "caplen", "len").collect()
    assert [(r["at"], r["caplen"], r["len"]) for r in sorted(found)] == [(1700000000999999 + k, k % 7, k % 7) for k in range(3000)]
    assert pcap.write(rows.limit(0), str(tmp_path / "none")) == [] and pcap.read(spark, str(tmp_path / "none")).count() == 0


def test_batches_of_empty_packets_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(pcap, "BATCH_BYTES", 160)
    (tmp_path / "e.pcap").write_bytes(pcap.dump([(1.0, b"")] * 25))
    assert [b.num_rows for b in pcap.PcapReader(str(tmp_path)).read(pcap.Capture(str(tmp_path / "e.pcap")))] == [10, 10, 5]


def test_capture_query_writes_parts(spark, tmp_path, monkeypatch):
    """capture_files doesn't put all packets into one task's file."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from fluxmere.plans import catalog

    seen = []
    monkeypatch.setattr(pcap, "write", lambda *a, write=pcap.write, **b: seen.append(write(*a, **b)) or seen[-1])
    n = 40_000
    pq.write_table(pa.table({"event_id": list(range(n)), "user_id": [1] * n, "ts": pa.array([1_700_000_000_000_000 + k for k in range(n)], pa.timestamp("us"))}), tmp_path / "events.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = catalog.QUERIES["capture_files"](spark, str(tmp_path))
        assert len(seen[0]) > 1
        assert sorted(r.packet_no for r in found.collect()) == list(range(1, n + 1))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
