"""Column functions on texts, paths and grades."""
