"""Streams of news: duplicates that were seen before are dropped, days are counted, and a batch is made useful as it comes."""

from .ingest import close_days, flow_days, index_stream, ingest_window, rerun_open, seen_first, verdicts
from .news import daily_counts, first_seen, index_batches, recent

__all__ = ["close_days", "daily_counts", "first_seen", "flow_days", "index_batches", "index_stream", "ingest_window", "recent", "rerun_open", "seen_first", "verdicts"]
