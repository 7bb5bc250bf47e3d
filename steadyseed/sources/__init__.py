"""Readers and writers."""

from steadyseed.sources.sinks import write_leaderboards, write_results
from steadyseed.sources.tables import load_table, read_csv, read_json, read_workbooks

__all__ = ["load_table", "read_csv", "read_json", "read_workbooks", "write_leaderboards", "write_results"]
