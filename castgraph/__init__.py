"""Provenance-aware credit analytics and corpus preparation as plain Spark DataFrames."""
