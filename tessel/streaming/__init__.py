"""Streams of points against solids that stand still."""
