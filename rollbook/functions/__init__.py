"""Column expressions and feature catalogue."""
