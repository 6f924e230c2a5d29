"""Protocol identification over a column of packets, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layers import ETHERNET, Packet, decode
from .rules import LEVEL, Model

SCHEMA = (
    "layers array<struct<offset:int,layer:int>>, payload_offset int, payload_length int, proto_parent int, proto_id int, ip_protocol int, src_ip string, dst_ip string, "
    "src_port int, dst_port int, src_mac string, dst_mac string, tcp_flags int"
)
LAYER_TYPE = pa.list_(pa.struct([("offset", pa.int32()), ("layer", pa.int32())]))


def protocol_of(p: Packet, data: bytes, model: Model) -> int:
    """By the top layer: transport by payload, then destination port, then source port; network by IP protocol; link by ethertype. 0 for unknown."""
    top = p.top
    if level := LEVEL.get(top):
        payload = data[p.payload : p.end]
        for ports, holds, spec, protocol in model.by_payload[level]:
            if ports and p.dst_port not in ports and p.src_port not in ports:
                continue
            if holds is not None and not holds(payload):
                continue
            if spec is not None:
                number, offset, width = spec
                if len(payload) < offset + width or number is not None and int.from_bytes(payload[offset : offset + width], "big") != number:
                    continue
            return protocol
        known = model.by_number[level]
        return known.get(p.dst_port) or known.get(p.src_port, 0)
    if 16 <= top < 25 and p.ip_protocol is not None:
        return model.by_number["l3"].get(p.ip_protocol, 0)
    if 1 <= top < 16 and p.ethertype is not None:
        return model.by_number["l2"].get(p.ethertype, 0)
    return 0


def identify(packets: DataFrame, model: Model | None = None, *, packet_column: str = "packet", start: int = ETHERNET) -> DataFrame:
    """packets with the columns of SCHEMA. A null packet has no layers and protocol 0."""
    model = model or Model()
    held = packets.sparkSession.sparkContext.broadcast(model)  # a dictionary of some hundred rules
    new = [x.split(" ", 1)[0] for x in SCHEMA.replace("array<struct<offset:int,layer:int>>", "x").split(", ")]
    kept = [c for c in packets.columns if c not in new]
    place = kept.index(packet_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            rows: list[list] = [[] for _ in new]
            for data in batch.column(place).to_pylist():
                data = data or b""
                p = decode(data, start)
                found = protocol_of(p, data, model)
                values = ([{"offset": a, "layer": k} for a, k in p.layers], p.payload, max(0, min(p.end, len(data)) - p.payload), model.parents.get(found, found), found, p.ip_protocol, p.src, p.dst, p.src_port, p.dst_port, p.src_mac, p.dst_mac, p.tcp_flags)
                for out, v in zip(rows, values, strict=True):
                    out.append(v)
            kinds = [LAYER_TYPE, *[pa.int32()] * 5, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(r, t) for r, t in zip(rows, kinds, strict=True))], names=[*kept, *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packets.schema.fields if f.name in kept)
    return packets.select(*kept).mapInArrow(run, f"{fields}, {SCHEMA}")


def named(identified: DataFrame, model: Model | None = None) -> DataFrame:
    """With protocol and its description, null for unknown ones; the dictionary's size is that of the rules, so it is broadcast."""
    entries = (model or Model()).dictionary(identified.sparkSession).select(F.col("id").alias("proto_id"), F.col("name").alias("protocol"), "description")
    return identified.join(F.broadcast(entries), "proto_id", "left")


def counts(identified: DataFrame, model: Model | None = None) -> DataFrame:
    """proto_id, protocol, packets."""
    return named(identified.groupBy("proto_id").agg(F.count(F.lit(1)).alias("packets")), model).select("proto_id", "protocol", "packets")
