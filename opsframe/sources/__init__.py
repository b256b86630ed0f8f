"""Readers, and the driver tables seen as the library's tables."""
