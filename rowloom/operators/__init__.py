"""Operators: DataFrames in, lazily planned DataFrames out."""
