"""Incremental analysis with Structured Streaming."""
