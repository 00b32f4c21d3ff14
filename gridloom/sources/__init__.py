"""Scans and sinks: table-to-grid adapter, workbook files, file catalogue, JSON lines."""
