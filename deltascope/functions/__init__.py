"""Column functions: scores, text measures."""
