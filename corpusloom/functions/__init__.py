"""Column functions: text, paths and languages."""
