"""Operators of the comparison engine: DataFrames in, DataFrames out."""
