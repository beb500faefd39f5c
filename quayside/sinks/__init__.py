"""Sinks: landed Parquet, published envelopes, dead letters, managed tables."""
