"""Statistics over columns and tables."""
