"""Structured Streaming forms of the hourly aggregation."""
