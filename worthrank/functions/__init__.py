"""Column-level scalar helpers."""
