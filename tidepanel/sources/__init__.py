"""Readers, ingest gates, dimensions and sinks."""
