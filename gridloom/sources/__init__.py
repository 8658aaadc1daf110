"""Scans, clean-up at the scan, and sinks."""
