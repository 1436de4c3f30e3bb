"""Structured Streaming forms of ingestion, hourly means and replay removal."""
