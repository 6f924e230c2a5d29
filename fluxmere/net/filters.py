"""Capture filters: by MAC or IP address, port, protocol and application, on either end or on both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions.network import cidr6_match, cidr_match, ip_in_range, mac_normal, port_in
from ..operators.base import Operator


def _either(test, spec: str, what: str) -> Column:
    """`x` on either end; `x,y` on the two ends, in either order."""
    parts = [p.strip() for p in spec.split(",")]
    src, dst = F.col(f"src_{what}"), F.col(f"dst_{what}")
    if len(parts) == 1:
        return F.coalesce(test(src, parts[0]) | test(dst, parts[0]), F.lit(False))
    if len(parts) == 2:
        a, b = parts
        return F.coalesce((test(src, a) & test(dst, b)) | (test(src, b) & test(dst, a)), F.lit(False))
    raise EngineError(f"one or two ends expected: {spec}")


def _ip(column: Column, spec: str) -> Column:
    if "-" in spec:
        low, high = spec.split("-", 1)
        return ip_in_range(column, low, high)
    if ":" in spec:
        return cidr6_match(column, spec)
    return cidr_match(column, spec)


def ip_address(spec: str) -> Column:
    """An address, a range a-b, a network a/n, or a pair of these."""
    return _either(_ip, spec, "ip")


def mac_address(spec: str) -> Column:
    return _either(lambda c, s: mac_normal(c) == mac_normal(F.lit(s)), spec, "mac")


def port(spec: str) -> Column:
    return _either(port_in, spec, "port")


def named_in(column: str, names: str) -> Column:
    listed = [n.strip().strip("'\"").lower() for n in names.strip("[] ").replace(";", ",").split(",") if n.strip()]
    return F.lower(F.col(column)).isin(listed)


def _operator(name: str, make) -> Operator:
    def run(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
        if "value" not in params:
            raise EngineError(f"capture.{name} needs value")
        return frames[0].where(make(params["value"]))

    return Operator("capture", name, run, f"rows that match a {name}")


OPERATORS = [
    _operator("ipaddress", ip_address),
    _operator("macaddress", mac_address),
    _operator("port", port),
    _operator("protocol", lambda v: named_in("protocol", v)),
    _operator("application", lambda v: named_in("application", v)),
]
