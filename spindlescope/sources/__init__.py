"""Snapshot scans, stage caches and sinks."""
