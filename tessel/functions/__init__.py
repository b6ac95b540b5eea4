"""Exact column arithmetic (SQL tier) and big-integer kernels (Arrow tier)."""
