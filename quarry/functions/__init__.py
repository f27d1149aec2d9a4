"""Column functions: text, numbers, paths and languages."""
