"""Streams: time windows with watermarks, sessions, joins, state, and queries that go on."""

from .queries import StreamRunner
from .windows import dedup, interval_join, running_totals, session, sliding, tumbling

__all__ = ["StreamRunner", "dedup", "interval_join", "running_totals", "session", "sliding", "tumbling"]
