"""Structured Streaming jobs over the access log."""
