"""Readers of files with schemas given beforehand: rows, feeds, price charts, universes, identities, labels and lines of text."""

from .captures import captured_items
from .feeds import announcement_rows, chart_prices, feed_items, market_announcements
from .files import as_declared, csv_rows, identity_map, json_lines, json_rows, labelled_fields, matching_lines, optional_csv, report_files, ticker_universe, training_rows
from .tables import context_rows, derived_rows, integrity_index

__all__ = [
    "announcement_rows", "as_declared", "captured_items", "chart_prices", "context_rows", "csv_rows", "derived_rows", "feed_items", "identity_map", "integrity_index", "json_lines", "json_rows",
    "labelled_fields", "market_announcements", "matching_lines", "optional_csv", "report_files", "ticker_universe", "training_rows",
]
