"""Sinks: scan-log append, processed datasets, metadata / metrics, models."""
