"""Scans, file formats and sinks."""
