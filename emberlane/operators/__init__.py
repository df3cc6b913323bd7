"""Operators: DataFrames and Columns in, DataFrames out, with column names as parameters."""
