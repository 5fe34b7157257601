"""Operators: every one maps DataFrames to DataFrames."""
