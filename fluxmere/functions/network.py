"""Addresses and ports as expressions that Catalyst can push and fold."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import EngineError

IPV4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"


def ip_to_long(ip: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    parts = F.split(ip, r"\.")
    value = sum((F.get(parts, F.lit(k)).cast("bigint") * (1 << (24 - 8 * k)) for k in range(4)), F.lit(0))
    return F.when(ip.rlike(IPV4), value)


def number_of(ip: str) -> int:
    parts = ip.strip().split(".")
    if len(parts) != 4 or not all(p.isdigit() and int(p) < 256 for p in parts):
        raise EngineError(f"bad IPv4 address: {ip}")
    return sum(int(p) << (24 - 8 * k) for k, p in enumerate(parts))


def cidr_match(ip: Column, network: str) -> Column:
    """Whether an address lies in 10.0.0.0/16; without a length it must be the address itself."""
    base, _, bits = network.partition("/")
    n = int(bits) if bits else 32
    if not 0 <= n <= 32:
        raise EngineError(f"bad prefix length: {network}")
    low = number_of(base) >> (32 - n) << (32 - n)
    return ip_to_long(ip).between(low, low + (1 << (32 - n)) - 1)


def cidr6_match(ip: Column, network: str) -> Column:
    """Whether an IPv6 address lies in 2001:db8::/32; false for anything else. Addresses have too many spellings for expressions."""
    try:
        held = ipaddress.IPv6Network(network, strict=False)
    except ValueError:
        raise EngineError(f"bad IPv6 network: {network}") from None

    def inside(x: str | None) -> bool:
        try:
            return x is not None and ":" in x and ipaddress.IPv6Address(x) in held
        except ValueError:
            return False

    @F.pandas_udf("boolean")
    def match(column: pd.Series) -> pd.Series:
        known = {x: inside(x) for x in column.unique()}
        return column.map(known).astype(bool)

    return match(ip)


def ip_in_range(ip: Column, low: str, high: str) -> Column:
    return ip_to_long(ip).between(number_of(low), number_of(high))


def mac_normal(mac: Column) -> Column:
    """Lower case with colons, from either separator or none."""
    bare = F.lower(F.regexp_replace(mac, "[^0-9A-Fa-f]", ""))
    return F.when(F.length(bare) == 12, F.regexp_replace(bare, "(..)(?=.)", "$1:"))


def port_in(port: Column, spec: str) -> Column:
    """80, 80-90 or a list of these, separated by semicolons."""
    found = F.lit(False)
    for part in spec.split(";"):
        low, _, high = part.strip().partition("-")
        try:
            found = found | port.between(int(low), int(high or low))
        except ValueError:
            raise EngineError(f"bad port: {part}") from None
    return found
