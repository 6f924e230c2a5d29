"""Protocols told by the fields that their payload starts with: one small reader a protocol, from its standard."""

from __future__ import annotations

import re
from collections.abc import Callable

#: Methods of RFC 9110, in its order, and that of RFC 5789.
HTTP_METHODS = (b"GET", b"HEAD", b"POST", b"PUT", b"DELETE", b"CONNECT", b"OPTIONS", b"TRACE", b"PATCH")
HTTP_VERSION = re.compile(rb"HTTP/\d\.\d")
#: Commands of RFC 959 in its order, then of RFC 2228, 2389, 2428 and 3659.
FTP_COMMANDS = frozenset(
    b"USER PASS ACCT CWD CDUP SMNT REIN QUIT PORT PASV TYPE STRU MODE RETR STOR STOU APPE ALLO REST RNFR RNTO ABOR DELE RMD MKD PWD LIST NLST SITE SYST STAT HELP NOOP "
    b"AUTH ADAT PROT PBSZ CCC MIC CONF ENC FEAT OPTS EPRT EPSV MDTM SIZE MLST MLSD".split()
)
#: Content types of a TLS record and types of a handshake message, RFC 8446 with those it took over.
CHANGE_CIPHER, ALERT, HANDSHAKE, APPLICATION = 20, 21, 22, 23
HANDSHAKES = frozenset((0, 1, 2, 4, 5, 8, 11, 12, 13, 14, 15, 16, 20, 21, 22, 24))
#: Most bytes of a protected record: 2^14 and what ciphers may add, RFC 5246.
TLS_RECORD = (1 << 14) + 2048
#: Static payload types that RFC 3551 assigns, by runs, and its dynamic ones.
RTP_TYPES = frozenset((*range(0, 19), 25, 26, 28, *range(31, 35), *range(96, 128)))
#: RTCP packet types: RFC 3550, 4585, 3611 and those assigned after them.
RTCP_TYPES = range(200, 211)


def _cotp_data(payload: bytes) -> bytes | None:
    """What a data TPDU (X.224) in a TPKT (RFC 1006) carries; None for anything else."""
    version, reserved, length = payload[:1], payload[1:2], int.from_bytes(payload[2:4], "big")
    if version != b"\x03" or reserved != b"\x00" or length < 7:
        return None
    indicator, code = payload[4:5], payload[5:6]
    return payload[7:] if indicator == b"\x02" and code == b"\xf0" else None


def s7comm(payload: bytes) -> bool:
    """Protocol number 50, then job, acknowledgement, acknowledgement with data or user data."""
    data = _cotp_data(payload)
    return data is not None and len(data) > 1 and data[0] == 50 and data[1] in (1, 2, 3, 7)


def mms(payload: bytes) -> bool:
    """Two session units (ISO 8327), give tokens and data transfer: both number 1 and without parameters."""
    data = _cotp_data(payload)
    if data is None or len(data) < 4:
        return False
    units = [(data[k], data[k + 1]) for k in (0, 2)]
    return units == [(1, 0), (1, 0)]


def dnp3(payload: bytes) -> bool:
    """Start octets and the rest of a link header with its checksum: ten octets (IEEE 1815)."""
    return len(payload) >= 10 and int.from_bytes(payload[:2], "big") == 0x0564


def ipmi(payload: bytes) -> bool:
    """An RMCP header (ASF 2.0): version 6, reserved, sequence, class; the class's low bits are 7 for IPMI."""
    return len(payload) >= 4 and payload[0] == 6 and payload[1] == 0 and payload[3] & 0x1F == 7


def http(payload: bytes) -> bool:
    """A request line or a status line (RFC 9112)."""
    line, end, _ = payload.partition(b"\r\n")
    parts = line.split(None, 2)
    if len(parts) < 2:
        return False
    if HTTP_VERSION.fullmatch(parts[0]):
        return len(parts[1]) == 3 and parts[1].isdigit() and b"1" <= parts[1][:1] <= b"5"
    return bool(end) and parts[0] in HTTP_METHODS and len(parts) == 3 and bool(HTTP_VERSION.fullmatch(parts[2].strip()))


def tls(payload: bytes) -> bool:
    """A record's type, version and length, and what a handshake or a change of cipher starts with."""
    if len(payload) < 5:
        return False
    kind, major, minor, length = payload[0], payload[1], payload[2], int.from_bytes(payload[3:5], "big")
    if major != 3 or not 1 <= minor <= 4 or length > TLS_RECORD:
        return False
    if kind == CHANGE_CIPHER:
        return length == 1 and payload[5:6] == b"\x01"
    if kind == HANDSHAKE:
        return len(payload) >= 9 and payload[5] in HANDSHAKES
    return kind in (ALERT, APPLICATION)


def mq(payload: bytes) -> bool:
    """A transmission segment header: its name, its length, and the byte order, big or little."""
    return len(payload) >= 9 and payload.startswith(b"TSH ") and payload[8] in (1, 2)


def rtcp(payload: bytes) -> bool:
    """Version 2 in the first two bits, then a packet type (RFC 3550)."""
    return len(payload) >= 4 and payload[0] >> 6 == 2 and payload[1] in RTCP_TYPES


def rtp(payload: bytes) -> bool:
    """A fixed header of twelve octets: version 2, then marker bit and an assigned payload type (RFC 3550, 3551)."""
    return len(payload) >= 12 and payload[0] >> 6 == 2 and payload[1] & 0x7F in RTP_TYPES


def ftp(payload: bytes) -> bool:
    """One command line: a command of any case, a blank and what it takes, if anything, CRLF."""
    if not payload.endswith(b"\r\n") or payload.count(b"\n") != 1:
        return False
    return payload[:-2].partition(b" ")[0].upper() in FTP_COMMANDS


READERS: dict[str, Callable[[bytes], bool]] = {f.__name__: f for f in (s7comm, mms, dnp3, ipmi, http, tls, mq, rtcp, rtp, ftp)}
