"""Packet decoding and session statistics as operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..operators.base import Operator, number, require
from . import filters
from . import identify as ident
from .rules import Model
from .sessions import IDLE, sessions

#: Rules of npi.application at most.
MOST_RULES = 500


def layers(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """Packets with layers, addresses, ports and protocol."""
    return ident.named(ident.identify(frames[0], packet_column=require(frames[0], params.get("column", "packet"))))


def protocols(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """Packets by protocol."""
    df = frames[0] if "proto_id" in frames[0].columns else ident.identify(frames[0])
    return ident.counts(df)


def dictionary(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """The rows with name and parent of their proto_id."""
    return ident.named(frames[0], Model())


def basic(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """Sessions with packets, bytes, duration and rate; `idle` seconds end one."""
    df = frames[0]
    if "src_ip" not in df.columns:
        df = ident.identify(df)
    if "len" not in df.columns:
        df = df.withColumn("len", F.octet_length("packet"))
    return sessions(df, time_column=params.get("time", "ts"), idle=int(number(params, "idle", IDLE)))


def application(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """Flows or packets (first frame) with application, by rules (second frame): application and any of protocol, ip, port.

    ip is an address or a network, on either end; port is n, n-m or a list; the first rule whose given parts all match
    counts. Rules become one expression, so there may be MOST_RULES of them.
    """
    if len(frames) != 2:
        raise EngineError("npi.application needs two frames: traffic and rules")
    flows, rules = frames
    listed = rules.limit(MOST_RULES + 1).collect()
    if len(listed) > MOST_RULES:
        raise EngineError(f"at most {MOST_RULES} rules")
    ends = [c.removeprefix("src_") for c in flows.columns if c in ("src_ip", "src_port")]
    found = F.lit(None).cast("string")
    for r in reversed([r.asDict() for r in listed]):
        test = F.lit(True)
        if r.get("protocol"):
            test = test & (F.lower("protocol") == r["protocol"].lower())
        if r.get("ip") and "ip" in ends:
            test = test & filters.ip_address(r["ip"])
        if r.get("port") and "port" in ends:
            test = test & filters.port(str(r["port"]))
        found = F.when(F.coalesce(test, F.lit(False)), F.lit(r["application"])).otherwise(found)
    return flows.withColumn("application", found)


OPERATORS = [
    Operator("npi", "application", application, "application by protocol, address and port", multi=True),
    Operator("npi", "identify", layers, "layers and protocol of packets"),
    Operator("npi", "protocols", protocols, "packets by protocol"),
    Operator("npi", "dictionary", dictionary, "names of protocol numbers"),
    Operator("npm", "basic", basic, "session statistics"),
]
