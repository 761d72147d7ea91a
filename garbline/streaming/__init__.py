"""Structured Streaming jobs over status, stock and engagement events."""
