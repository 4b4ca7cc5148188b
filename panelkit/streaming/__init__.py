"""Structured Streaming forms of the ingest and scoring operators."""
