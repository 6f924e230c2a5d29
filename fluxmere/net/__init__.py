"""Packets: layers, protocol identification, sessions, filters and storage policies."""
