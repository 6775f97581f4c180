"""Continuous ingest of document versions."""
