"""Queries over collections of multi-channel array data, and tables beside them, on Spark."""
