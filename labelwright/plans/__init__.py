"""The registered queries of the screening engine."""

from . import advisory_queries, desk_queries, gap_queries, more_queries, resolution_queries, retrieval_queries, source_queries, storage_queries, stream_queries, text_queries, verdict_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "advisory_queries", "desk_queries", "gap_queries", "more_queries", "resolution_queries", "retrieval_queries", "source_queries", "storage_queries", "stream_queries", "text_queries", "verdict_queries"]
