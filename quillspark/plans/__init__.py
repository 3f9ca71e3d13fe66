"""Whole plans: the cycle, and queries over the provided tables."""
