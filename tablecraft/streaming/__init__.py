"""Incremental loads, change feeds and running metrics with Structured Streaming."""
