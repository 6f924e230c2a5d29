"""Channels: named sources and sinks that resolve to DataFrames."""
