"""Structured Streaming: replay-safe ingestion and windowed message dedupe."""
