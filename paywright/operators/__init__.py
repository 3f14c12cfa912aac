"""Operators: DataFrames in, DataFrames out, lazily."""
