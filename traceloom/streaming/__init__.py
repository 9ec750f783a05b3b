"""Incremental loads as Structured Streaming."""
