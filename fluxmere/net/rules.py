"""Protocols and the rules that tell them: by ethertype, IP protocol, port, payload bytes and payload patterns."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

import yaml
from pyspark.sql import DataFrame, SparkSession

from .layers import NAMES, SCTP, TCP, UDP
from .payloads import READERS


@dataclass(frozen=True)
class Rule:
    """All conditions that are given must hold. level: tcp, udp, sctp, l4 (any of them), l3 or l2.

    enumerate: (bytes at an offset of the payload as a number, offset, width); number None stands for any.
    reader: the name of a function of payloads.
    """

    protocol: int
    level: str
    values: frozenset[int] = frozenset()
    pattern: bytes | None = None
    enumerate: tuple[int | None, int, int] | None = None
    reader: str | None = None

    @property
    def looks_inside(self) -> bool:
        return self.pattern is not None or self.enumerate is not None or self.reader is not None


@dataclass(frozen=True)
class Protocol:
    id: int
    name: str
    description: str
    parent: int
    rules: tuple[Rule, ...] = ()


#: Numbers of protocols in results, and the numbers by which standards tell them; fixed values.
#: name, id, description, then level and values of each rule.
BY_NUMBER = (
    ("ARP", 256, "Address Resolution Protocol", ("l2", 0x0806)),
    ("RARP", 257, "Reverse Address Resolution Protocol", ("l2", 0x8035)),
    ("PTP", 258, "Precision Time Protocol", ("l2", 0x88F7), ("udp", 319, 320)),
    ("PPPOE-Discovery", 259, "PPP over Ethernet discovery", ("l2", 0x8863)),
    ("GOOSE", 260, "Generic Object Oriented Substation Event", ("l2", 0x88B8)),
    ("GSSE", 261, "Generic Substation State Event", ("l2", 0x88B9)),
    ("SMV", 262, "Sampled Measured Values", ("l2", 0x88BA)),
    ("LLAP", 263, "LocalTalk Link Access Protocol", ("l2", 0x809B)),
    ("IPX", 264, "Internetwork Packet Exchange", ("l2", 0x8137)),
    ("ICMP", 512, "Internet Control Message Protocol", ("l3", 1)),
    ("ICMPv6", 560, "Internet Control Message Protocol version 6", ("l3", 58)),
    ("IGMP", 600, "Internet Group Management Protocol", ("l3", 2)),
    ("GGP", 601, "Gateway-to-Gateway Protocol", ("l3", 3)),
    ("EGP", 602, "Exterior Gateway Protocol", ("l3", 8)),
    ("IGRP", 603, "Interior Gateway Routing Protocol", ("l3", 9)),
    ("RSVP", 604, "Resource Reservation Protocol", ("l3", 46)),
    ("EIGRP", 605, "Enhanced Interior Gateway Routing Protocol", ("l3", 88)),
    ("OSPF", 606, "Open Shortest Path First", ("l3", 89)),
    ("PGM", 607, "Pragmatic General Multicast", ("l3", 113)),
    ("DNS", 1024, "Domain Name System", ("l4", 53)),
    ("SNMP", 1025, "Simple Network Management Protocol", ("l4", 161, 162)),
    ("DHCP", 1026, "Dynamic Host Configuration Protocol", ("l4", 67, 68)),
    ("DHCPv6", 1027, "Dynamic Host Configuration Protocol for IPv6", ("l4", 546, 547)),
    ("FTP", 1028, "File Transfer Protocol", ("tcp", 21)),
    ("FTP_DATA", 1029, "File Transfer Protocol, data", ("tcp", 20)),
    ("SSH", 1030, "Secure Shell", ("tcp", 22)),
    ("TELNET", 1031, "Telnet", ("tcp", 23)),
    ("SMTP", 1032, "Simple Mail Transfer Protocol", ("tcp", 25)),
    ("POP2", 1033, "Post Office Protocol 2", ("tcp", 109)),
    ("POP3", 1034, "Post Office Protocol 3", ("tcp", 110)),
    ("IMAP4", 1035, "Internet Message Access Protocol", ("tcp", 143)),
    ("IMAP3", 1036, "Interactive Mail Access Protocol 3", ("tcp", 220)),
    ("TFTP", 1037, "Trivial File Transfer Protocol", ("udp", 69)),
    ("SFTP", 1038, "Simple File Transfer Protocol", ("tcp", 115)),
    ("BGP", 1039, "Border Gateway Protocol", ("tcp", 179)),
    ("GTP_C", 1040, "GPRS Tunnelling Protocol, control", ("udp", 2123)),
    ("RIP", 1041, "Routing Information Protocol", ("udp", 520)),
    ("SSDP", 1042, "Simple Service Discovery Protocol", ("udp", 1900)),
    ("FTPS", 1043, "FTP over TLS", ("tcp", 990)),
    ("FTPS_DATA", 1044, "FTP over TLS, data", ("tcp", 989)),
    ("TELNET_SSL", 1045, "Telnet over TLS", ("tcp", 992)),
    ("SMTP_SSL", 1046, "SMTP over TLS", ("tcp", 465)),
    ("IMAP4_SSL", 1047, "IMAP over TLS", ("tcp", 993)),
    ("POP3_SSL", 1048, "POP3 over TLS", ("tcp", 995)),
    ("NTP", 1049, "Network Time Protocol", ("l4", 123)),
    ("RDP", 1050, "Remote Desktop Protocol", ("tcp", 3389)),
    ("MODBUS_TCP", 1051, "Modbus over TCP", ("l4", 502)),
    ("IEC104", 1054, "IEC 60870-5-104", ("l4", 2404)),
    ("SIP", 1056, "Session Initiation Protocol", ("l4", 5060)),
    ("LDAP", 1057, "Lightweight Directory Access Protocol", ("tcp", 389)),
    ("LLRP", 1058, "Low Level Reader Protocol", ("tcp", 5084)),
    ("MYSQL", 1065, "MySQL", ("tcp", 3306)),
    ("MSSQL", 1066, "Microsoft SQL Server", ("tcp", 1433)),
    ("PostgreSQL", 1067, "PostgreSQL", ("tcp", 5432)),
)
#: NetBIOS over TCP and its parts; fixed values.
NETBIOS = (("NETBIOS", 1059, "NetBIOS"), ("NETBIOS-NameService", 1060, "NetBIOS name service", ("l4", 137)), ("NETBIOS-DatagramService", 1061, "NetBIOS datagram service", ("udp", 138)), ("NETBIOS-SessionService", 1062, "NetBIOS session service", ("tcp", 139)))
#: Protocols told by fields of their payload: name, id, description, level, ports, reader; fixed numbers, see payloads.
BY_PAYLOAD = (
    ("S7COMM", 1052, "Siemens S7 communication", "tcp", (102,), "s7comm"),
    ("MMS", 1053, "Manufacturing Message Specification", "tcp", (102,), "mms"),
    ("DNP3", 1055, "Distributed Network Protocol 3", "tcp", (20000,), "dnp3"),
    ("IPMI", 1068, "Intelligent Platform Management Interface", "udp", (623,), "ipmi"),
    ("HTTP", 2000, "Hypertext Transfer Protocol", "l4", (), "http"),
    ("TLS", 2001, "Transport Layer Security", "tcp", (), "tls"),
    ("MQ", 2002, "WebSphere MQ", "tcp", (), "mq"),
    ("RTCP", 2003, "Real-time Transport Control Protocol", "udp", (), "rtcp"),
    ("RTP", 2004, "Real-time Transport Protocol", "udp", (), "rtp"),
)


def builtin() -> list[Protocol]:
    """Layers and protocols; a protocol without a parent is its own."""
    out = [Protocol(k, n, n, k) for k, n in NAMES.items()]
    for name, ident, text, *found in BY_NUMBER:
        out.append(Protocol(ident, name, text, ident, tuple(Rule(ident, level, frozenset(v)) for level, *v in found)))
    for name, ident, text, *found in NETBIOS:
        out.append(Protocol(ident, name, text, 1059, tuple(Rule(ident, level, frozenset(v)) for level, *v in found)))
    for name, ident, text, level, ports, reader in BY_PAYLOAD:
        out.append(Protocol(ident, name, text, ident, (Rule(ident, level, frozenset(ports), reader=reader),)))
    # FTP on any port, by its commands.
    return [p if p.name != "FTP" else Protocol(p.id, p.name, p.description, p.parent, (*p.rules, Rule(p.id, "l4", reader="ftp"))) for p in out]


def from_yaml(text: str) -> list[Protocol]:
    """A dictionary file: a list of {name, id, description, parent?, rules: [{level, values?, pattern?, enumerate?}]}.

    Entries without a description are left out, as are those that repeat an id or a name. enumerate is number:offset:width, * for any number.
    """
    out, seen = [], set()
    for x in yaml.safe_load(text) or []:
        if not x.get("description") or x["id"] in seen or x["name"] in seen:
            continue
        seen |= {x["id"], x["name"]}
        rules = []
        for r in x.get("rules", ()):
            number, offset, width = str(r["enumerate"]).split(":") if r.get("enumerate") else (None,) * 3
            spec = (None if number == "*" else int(number, 0), int(offset), int(width)) if width else None
            values = r.get("values", [])
            rules.append(Rule(x["id"], r["level"], frozenset(values if isinstance(values, list) else [values]), r["pattern"].encode("latin-1") if r.get("pattern") else None, spec))
        out.append(Protocol(x["id"], x["name"], x["description"], x.get("parent", x["id"]), tuple(rules)))
    return out


@dataclass
class Model:
    """Protocols compiled for lookup. Of rules for the same number the later one counts; patterns are tried in order and the first that holds wins."""

    protocols: list[Protocol] = field(default_factory=builtin)

    @cached_property
    def parents(self) -> dict[int, int]:
        return {p.id: p.parent for p in self.protocols}

    @cached_property
    def by_number(self) -> dict[str, dict[int, int]]:
        """Level to number to protocol, for rules by number alone."""
        out: dict[str, dict[int, int]] = {"l2": {}, "l3": {}, "tcp": {}, "udp": {}, "sctp": {}}
        for r in self._rules():
            if not r.looks_inside:
                for level in ("tcp", "udp", "sctp") if r.level == "l4" else (r.level,):
                    out[level].update(dict.fromkeys(r.values, r.protocol))
        return out

    @cached_property
    def by_payload(self) -> dict[str, list[tuple[frozenset[int], Callable | None, tuple | None, int]]]:
        """Level to rules that look at the payload, as (ports, test of the payload, enumerate, protocol): those that name ports first."""
        out: dict[str, list] = {"tcp": [], "udp": [], "sctp": []}
        for r in sorted((r for r in self._rules() if r.looks_inside), key=lambda r: not r.values):
            made = re.compile(r.pattern, re.DOTALL).match if r.pattern is not None else READERS[r.reader] if r.reader else None
            for level in ("tcp", "udp", "sctp") if r.level == "l4" else (r.level,):
                if level in out:
                    out[level].append((r.values, made, r.enumerate, r.protocol))
        return out

    def _rules(self):
        return (r for p in self.protocols for r in p.rules)

    def dictionary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(p.id, p.name, p.description, p.parent) for p in self.protocols], "id int, name string, description string, parent int")


LEVEL = {TCP: "tcp", UDP: "udp", SCTP: "sctp"}
