"""Operators on versioned metadata: DataFrames in, DataFrames out."""
