"""Lowering to DataFrames, and comparison of results."""
