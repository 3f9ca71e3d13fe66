"""Governed document analytics on Spark."""
