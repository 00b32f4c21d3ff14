"""Operators for training-data pipelines: deduplication, extraction, quality, mixing and packing."""
