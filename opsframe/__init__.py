"""Spark operators for e-commerce operations data."""
