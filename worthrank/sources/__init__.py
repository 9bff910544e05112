"""Readers for the task formats and the driver test-data views."""
