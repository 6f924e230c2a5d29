"""Storage policies: what of a packet is kept, and which packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..operators.base import STORAGE, Operator
from .filters import ip_address, mac_address, named_in, port

#: Protocols whose payload is encrypted; fixed values.
ENCRYPTED = ("TLS", "SSH", "FTPS", "FTPS_DATA", "TELNET_SSL", "SMTP_SSL", "IMAP4_SSL", "POP3_SSL")


def _size(params: dict[str, str]) -> int:
    value = params.get("size") or params.get("value") or ""
    if not value.isdigit():
        raise EngineError("size must be a number of bytes")
    return int(value)


def cut_packet(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """The first `size` bytes of each packet."""
    return frames[0].withColumn("packet", F.substring("packet", 1, _size(params)))


def cut_payload(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """Headers and the first `size` bytes of payload."""
    return frames[0].withColumn("packet", F.substring(F.col("packet"), F.lit(1), F.col("payload_offset") + _size(params)))


def exclude_encrypted(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    return frames[0].where(~F.coalesce(F.col("protocol").isin(*ENCRYPTED), F.lit(False)))


def exclude_protocol(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    return frames[0].where(~F.coalesce(named_in("protocol", params.get("value", "")), F.lit(False)))


def include_protocol(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    return frames[0].where(named_in("protocol", params.get("value", "")))


def include_address(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """Packets that match any of macaddress, ipaddress and port."""
    tests = [make(params[k]) for k, make in (("macaddress", mac_address), ("ipaddress", ip_address), ("port", port)) if k in params]
    if not tests:
        raise EngineError("include.address needs macaddress, ipaddress or port")
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return frames[0].where(found)


OPERATORS = [
    Operator(c, n, f, (f.__doc__ or "").strip(), STORAGE)
    for c, n, f in (("cut", "packet", cut_packet), ("cut", "payload", cut_payload), ("exclude", "encrypted", exclude_encrypted), ("exclude", "protocol", exclude_protocol), ("include", "protocol", include_protocol), ("include", "address", include_address))
]
