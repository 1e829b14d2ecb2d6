"""Column expressions and fixed word tables."""
