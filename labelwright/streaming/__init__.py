"""Structured Streaming forms: windows with late data, once-only keys, a cache that expires, exactly-once sinks, and confirmations."""

from .cache import ttl_cache
from .confirmations import confirmed
from .sinks import compact, done_keys, latest, once_each
from .windows import once_per_key, upsert_latest, windowed_counts

__all__ = ["compact", "confirmed", "done_keys", "latest", "once_each", "once_per_key", "ttl_cache", "upsert_latest", "windowed_counts"]
