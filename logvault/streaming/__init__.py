"""Structured Streaming forms: continuous ingest (T02) and sample grids."""
