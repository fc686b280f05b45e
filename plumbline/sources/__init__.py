"""Scans, cleaning of raw text tables, and sinks."""
