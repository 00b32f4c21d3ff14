"""Spreadsheet-lake analytics on Spark: grids of cells, regions, typed views, lineage, edits, scoring."""

from gridloom.lake import Lake
from gridloom.session import build_session, configure

__all__ = ["Lake", "build_session", "configure"]
