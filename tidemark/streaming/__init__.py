"""Structured Streaming ingest of revised observations."""
