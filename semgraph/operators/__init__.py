"""Operators: DataFrames and configuration in, DataFrames out."""
