"""Layers of a packet, by the RFCs: link, network and transport headers and the tunnels that start anew.

A packet is decoded header by header; each decoder says where the next header starts and what it is.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

#: Layer numbers that results carry; fixed values.
NONE = 0
ETHERNET, VLAN, PPPOE, PPP, MPLS = 2, 3, 4, 5, 6
IPV4, IPV6, HOPOPTS, ROUTING, FRAGMENT, ESP, AH, DSTOPTS, GRE = 17, 18, 19, 20, 21, 22, 23, 24, 25
TCP, UDP, SCTP, DCCP, VXLAN, VXLAN_GPE, GENEVE, L2TP, GTP = 33, 34, 35, 36, 37, 38, 39, 40, 41
NAMES = {
    ETHERNET: "ETHERNET", VLAN: "VLAN", PPPOE: "PPPoE_Session", PPP: "PPP", MPLS: "MPLS", IPV4: "IPv4", IPV6: "IPv6", HOPOPTS: "IPv6_EXT_HOPOPTS", ROUTING: "IPv6_EXT_ROUTING",
    FRAGMENT: "IPv6_EXT_FRAGMENT", ESP: "IPv6_EXT_ESP", AH: "IPv6_EXT_AH", DSTOPTS: "IPv6_EXT_DSTOPTS", GRE: "GRE", TCP: "TCP", UDP: "UDP", SCTP: "SCTP", DCCP: "DCCP", VXLAN: "VXLAN",
    VXLAN_GPE: "VXLAN_GPE", GENEVE: "GENEVE", L2TP: "L2TP", GTP: "GTP",
}

#: Most layers of a packet; fixed value.
MOST = 15
#: Ethertypes, IP protocols, PPP protocols and tunnel ports, as assigned; fixed values.
ETHERTYPES = {0x0800: IPV4, 0x86DD: IPV6, 0x8100: VLAN, 0x88A8: VLAN, 0x8864: PPPOE, 0x8847: MPLS, 0x8848: MPLS, 0x6558: ETHERNET}
IP_PROTOCOLS = {4: IPV4, 41: IPV6, 6: TCP, 17: UDP, 132: SCTP, 47: GRE, 0: HOPOPTS, 43: ROUTING, 44: FRAGMENT, 50: ESP, 51: AH, 60: DSTOPTS, 137: MPLS}
PPP_PROTOCOLS = {0x0021: IPV4, 0x0057: IPV6, 0x0281: MPLS, 0x0283: MPLS}
UDP_TUNNELS = {1701: L2TP, 4754: GRE, 4789: VXLAN, 4790: VXLAN_GPE, 6081: GENEVE, 3544: IPV6, 2152: GTP}
#: Next protocol of VXLAN-GPE.
GPE_NEXT = {1: IPV4, 2: IPV6, 3: ETHERNET, 5: MPLS}


@dataclass
class Packet:
    """What decoding finds; the innermost addresses and ports win."""

    layers: list[tuple[int, int]] = field(default_factory=list)
    payload: int = 0
    ethertype: int | None = None
    ip_protocol: int | None = None
    src: str | None = None
    dst: str | None = None
    src_port: int | None = None
    dst_port: int | None = None
    src_mac: str | None = None
    dst_mac: str | None = None
    tcp_flags: int | None = None
    end: int = 0

    @property
    def top(self) -> int:
        return self.layers[-1][1] if self.layers else NONE


def _u16(data: bytes, at: int) -> int:
    return struct.unpack_from("!H", data, at)[0]


class _Short(Exception):
    """The header goes on beyond the captured bytes."""


def decode(data: bytes, start: int = ETHERNET) -> Packet:
    """All layers of a packet; it ends at a header that is cut off, unknown or the last."""
    p = Packet(end=len(data))
    at, layer = 0, start
    while layer != NONE and at < p.end and len(p.layers) < MOST:
        try:
            size, following = DECODERS[layer](data, at, p)
        except (_Short, struct.error, IndexError):
            break
        if at + size > len(data):
            break
        p.layers.append((at, layer))
        at += size
        layer = following
    p.payload = min(at, len(data))
    return p


def _need(data: bytes, at: int, n: int) -> None:
    if at + n > len(data):
        raise _Short


def _mac(data: bytes, at: int) -> str:
    return data[at : at + 6].hex(":")


def _ethernet(data: bytes, at: int, p: Packet) -> tuple[int, int]:
    _need(data, at, 14)
    p.dst_mac, p.src_mac, p.ethertype = _mac(data, at), _mac(data, at + 6), _u16(data, at + 12)
    return 14, ETHERTYPES.get(p.ethertype, NONE)


def _vlan(data: bytes, at: int, p: Packet) -> tuple[int, int]:
    _need(data, at, 4)
    p.ethertype = _u16(data, at + 2)
    return 4, ETHERTYPES.get(p.ethertype, NONE)


def _pppoe(data: bytes, at: int, p: Packet) -> tuple[int, int]:
    _need(data, at, 6)
    return 6, PPP


def _ppp(data: bytes, at: int, p: Packet) -> tuple[int, int]:
    """The protocol field, after address and control where these are sent."""
    skip = 2 if data[at : at + 2] == b"\xff\x03" else 0
    # A field whose first byte is odd has that byte only.
    if data[at + skip] & 1:
        return skip + 1, PPP_PROTOCOLS.get(data[at + skip], NONE)
    return skip + 2, PPP_PROTOCOLS.get(_u16(data, at + skip), NONE)


def _mpls(data: bytes, at: int, p: Packet) -> tuple[int, int]:
    """The bottom of the stack is the lowest bit of the third byte; what follows shows itself by its first half byte."""
    _need(data, at, 4)
    if not data[at + 2] & 1:
        return 4, MPLS
    version = data[at + 4] >> 4 if at + 4 < len(data) else 0
    return 4, {4: IPV4, 6: IPV6}.get(version, ETHERNET if version == 0 and at + 4 < len(data) else NONE)


def _ipv4(data: bytes, at: int, p: Packet) -> tuple[int, int]:
    _need(data, at, 20)
    size = (data[at] & 15) * 4
    if data[at] >> 4 != 4 or size < 20:
        raise _Short
    p.ip_protocol = data[at + 9]
    p.src, p.dst = (".".join(map(str, data[k : k + 4])) for k in (at + 12, at + 16))
    # Padding behind the datagram isn't payload.
    total = _u16(data, at + 2)
    if total >= size:
        p.end = min(p.end, at + total)
    # Only the first fragment has the next header.
    return size, IP_PROTOCOLS.get(p.ip_protocol, NONE) if not _u16(data, at + 6) & 0x1FFF else NONE


def _ipv6(data: bytes, at: int, p: Packet) -> tuple[int, int]:
    _need(data, at, 40)
    if data[at] >> 4 != 6:
        raise _Short
    p.ip_protocol = data[at + 6]
    p.src, p.dst = (":".join(f"{_u16(data, k + j):x}" for j in range(0, 16, 2)) for k in (at + 8, at + 24))
    length = _u16(data, at + 4)
    if length:
        p.end = min(p.end, at + 40 + length)
    return 40, IP_PROTOCOLS.get(p.ip_protocol, NONE)


def _extension(data: bytes, at: int, p: Packet) -> tuple[int, int]:
    _need(data, at, 8)
    p.ip_protocol = data[at]
    return (data[at + 1] + 1) * 8, IP_PROTOCOLS.get(p.ip_protocol, NONE)


def _fragment(data: bytes, at: int, p: Packet) -> tuple[int, int]:
    _need(data, at, 8)
    p.ip_protocol = data[at]
    return 8, IP_PROTOCOLS.get(p.ip_protocol, NONE) if not _u16(data, at + 2) >> 3 else NONE


def _ah(data: bytes, at: int, p: Packet) -> tuple[int, int]:
    _need(data, at, 12)
    p.ip_protocol = data[at]
    return (data[at + 1] + 2) * 4, IP_PROTOCOLS.get(p.ip_protocol, NONE)


def _esp(data: bytes, at: int, p: Packet) -> tuple[int, int]:
    """What follows is encrypted."""
    _need(data, at, 8)
    return 8, NONE


def _gre(data: bytes, at: int, p: Packet) -> tuple[int, int]:
    _need(data, at, 4)
    flags, following = _u16(data, at), _u16(data, at + 2)
    size = 4 + 4 * bool(flags & 0xC000) + 4 * bool(flags & 0x2000) + 4 * bool(flags & 0x1000)
    if flags & 7 == 1:  # enhanced GRE carries PPP, with an acknowledgement number if A is set
        return size + 4 * bool(flags & 0x0080), PPP
    p.ethertype = following
    return size, ETHERTYPES.get(following, NONE)


def _tcp(data: bytes, at: int, p: Packet) -> tuple[int, int]:
    _need(data, at, 20)
    p.src_port, p.dst_port, p.tcp_flags = _u16(data, at), _u16(data, at + 2), data[at + 13]
    size = (data[at + 12] >> 4) * 4
    if size < 20:
        raise _Short
    return size, NONE


def _udp(data: bytes, at: int, p: Packet) -> tuple[int, int]:
    """A tunnel by its port; where both ports are tunnels the source's counts."""
    _need(data, at, 8)
    p.src_port, p.dst_port = _u16(data, at), _u16(data, at + 2)
    return 8, UDP_TUNNELS.get(p.src_port) or UDP_TUNNELS.get(p.dst_port, NONE)


def _sctp(data: bytes, at: int, p: Packet) -> tuple[int, int]:
    """The common header and the first chunk's: payload is that of a DATA chunk."""
    _need(data, at, 12)
    p.src_port, p.dst_port = _u16(data, at), _u16(data, at + 2)
    if at + 16 > len(data):
        return 12, NONE
    return (28 if data[at + 12] == 0 else 12 + _u16(data, at + 14)), NONE


def _vxlan(data: bytes, at: int, p: Packet) -> tuple[int, int]:
    _need(data, at, 8)
    return 8, ETHERNET


def _vxlan_gpe(data: bytes, at: int, p: Packet) -> tuple[int, int]:
    _need(data, at, 8)
    return 8, GPE_NEXT.get(data[at + 3], NONE)


def _geneve(data: bytes, at: int, p: Packet) -> tuple[int, int]:
    _need(data, at, 8)
    p.ethertype = _u16(data, at + 2)
    return 8 + (data[at] & 63) * 4, ETHERTYPES.get(p.ethertype, NONE)


def _l2tp(data: bytes, at: int, p: Packet) -> tuple[int, int]:
    """Version 2: length, sequence and offset fields are there if their bits are set; control messages carry no PPP."""
    _need(data, at, 6)
    flags = _u16(data, at)
    if flags & 15 != 2:
        return 6, NONE
    size = 6 + 2 * bool(flags & 0x4000) + 4 * bool(flags & 0x0800)
    if flags & 0x0200:
        size += 2 + _u16(data, at + size)
    return size, NONE if flags & 0x8000 else PPP


def _gtp(data: bytes, at: int, p: Packet) -> tuple[int, int]:
    """Version 1 user plane: a G-PDU carries IP, told by its version."""
    _need(data, at, 8)
    flags = data[at]
    size = 8
    if flags & 7:
        size += 4
        following = data[at + 11] if flags & 4 else 0
        while following:
            length = data[at + size] * 4
            if not length:
                raise _Short
            following = data[at + size + length - 1]
            size += length
    if flags >> 5 != 1 or data[at + 1] != 255 or at + size >= len(data):
        return size, NONE
    return size, {4: IPV4, 6: IPV6}.get(data[at + size] >> 4, NONE)


DECODERS = {
    ETHERNET: _ethernet, VLAN: _vlan, PPPOE: _pppoe, PPP: _ppp, MPLS: _mpls, IPV4: _ipv4, IPV6: _ipv6, HOPOPTS: _extension, ROUTING: _extension, DSTOPTS: _extension, FRAGMENT: _fragment,
    AH: _ah, ESP: _esp, GRE: _gre, TCP: _tcp, UDP: _udp, SCTP: _sctp, VXLAN: _vxlan, VXLAN_GPE: _vxlan_gpe, GENEVE: _geneve, L2TP: _l2tp, GTP: _gtp,
}
