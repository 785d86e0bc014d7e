"""Where files come from and where an index is kept."""
