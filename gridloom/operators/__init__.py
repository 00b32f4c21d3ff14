"""Set-based operators over the cell table."""
