"""Structured Streaming over the append-only check table."""
