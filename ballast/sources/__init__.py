"""Scans, text extraction and sinks."""
