"""Structured Streaming twins of the capture and processing steps."""
