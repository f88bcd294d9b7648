"""Scans, memory tables and sinks."""
