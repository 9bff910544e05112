"""Structured Streaming scoring and windowed counts."""
