"""Scans: Parquet, JSON Lines and delimited text, all through Spark's own readers."""

from prosegauge.sources.tables import read_jsonl, read_table, read_text_documents

__all__ = ["read_jsonl", "read_table", "read_text_documents"]
