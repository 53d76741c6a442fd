"""Structured Streaming form of the hourly counts."""
