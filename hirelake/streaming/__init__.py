"""Structured Streaming forms of ingest, source state and the event log."""
