"""Structured Streaming forms of ingest, scoring and alerts."""
