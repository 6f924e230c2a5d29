"""Column functions of the engine, all JVM-side."""

from .network import cidr_match, ip_in_range, ip_to_long, mac_normal, port_in

__all__ = ["cidr_match", "ip_in_range", "ip_to_long", "mac_normal", "port_in"]
