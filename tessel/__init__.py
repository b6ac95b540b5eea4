"""Exact solid geometry on Spark tables."""
