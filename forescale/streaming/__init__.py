"""Structured Streaming forms of the ingest, rollup and scoring steps."""
