"""Scans and sinks for pixel tables, vector layers and file listings."""
